"""The sources of the catalogue library."""
