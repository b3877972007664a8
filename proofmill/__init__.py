"""Quotation verification, passage search, extraction grids and run scoring as Spark plans."""
