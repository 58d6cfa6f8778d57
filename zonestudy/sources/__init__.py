"""Bar exports, Parquet tables, scored events and the registry of studies."""
