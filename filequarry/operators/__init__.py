"""The operators of the catalogue library."""
