"""The functions of the catalogue library."""
