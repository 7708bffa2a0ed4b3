"""Column functions: no function here runs a query or a line of Python per row."""
