"""Geospatial dataset catalog, ingest and query jobs written as Spark DataFrame programs."""
