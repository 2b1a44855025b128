"""Where tables live: files, versioned snapshots, foreign Parquet, virtual tables."""
