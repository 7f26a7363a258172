"""Spark-first warehouse observability, lineage and impact analysis."""
