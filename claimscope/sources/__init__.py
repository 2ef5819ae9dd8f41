"""Sources and sinks: parquet tables, the claims view, CSV import, exports."""
