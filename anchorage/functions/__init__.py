"""Column functions on text and inline links."""
