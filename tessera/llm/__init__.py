"""Corpus operators for large text collections: one module per operator, queries in ``queries``."""
