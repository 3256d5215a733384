"""Where logs come from: Parquet tables, a log derived from events, and segment files."""
