"""A PySpark engine for dataset curation, benchmark telemetry and evaluation analytics."""
