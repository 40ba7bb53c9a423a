"""Lineage-graph analytics on Spark: versioned property graphs, traversal, diff, search and data-quality operators."""

__version__ = "0.1.0"
