"""The ingest path over unbounded input."""
