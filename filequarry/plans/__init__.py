"""The plans of the catalogue library."""
