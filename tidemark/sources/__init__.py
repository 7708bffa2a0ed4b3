"""Readers and writers: landing with manifests, files, paged REST, JDBC, versioned tables."""
