"""PySpark jobs for field observations: geometry, ingest, annotation and image planning."""
