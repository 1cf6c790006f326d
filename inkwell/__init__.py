"""Inkwell: document search and index analytics expressed as Spark DataFrame plans."""
