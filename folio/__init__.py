"""Folio: processing of large collections of books and web articles on Spark."""

__version__ = "0.1.0"
