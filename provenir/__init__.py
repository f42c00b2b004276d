"""Catalog, lineage and change analytics as lazy Spark DataFrames."""
