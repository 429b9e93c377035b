"""Writers: SSSOM, JSON lines, property-graph files, Parquet."""
