"""Catalogue cleaning, resolution, enrichment, scoring and search as Spark jobs."""
