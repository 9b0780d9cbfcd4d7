"""Queries over the driver tables: views, plans and SQL."""
