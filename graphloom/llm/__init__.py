"""Operators for large text corpora. Nothing else in graphloom imports this subpackage."""
