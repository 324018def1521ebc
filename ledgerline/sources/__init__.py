"""Where rows come from and go to: versioned tables, Parquet, CSV, files and the one-string format."""
