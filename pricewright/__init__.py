"""Batch price-list analytics on Spark: extraction, resolution, narrowing, grids and audits as DataFrames."""
