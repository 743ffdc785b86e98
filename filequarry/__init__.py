"""Catalogue analytics for large file collections, expressed as Spark DataFrame plans."""
