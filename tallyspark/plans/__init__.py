"""Inputs made from the driver's tables, every query, and the SQL that says the same."""

from tallyspark.plans import more, pages, readers

__all__ = ["more", "pages", "readers"]
