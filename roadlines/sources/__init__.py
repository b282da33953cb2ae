"""Readers for delimited text and line shapefiles, and the ingest job."""
