"""Queries: operators applied to the driver tables, with their oracles."""
