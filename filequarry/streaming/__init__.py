"""The streaming of the catalogue library."""
