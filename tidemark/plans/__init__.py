"""Registered queries: each a plan over the tables, with an independent SQL statement of its result."""
