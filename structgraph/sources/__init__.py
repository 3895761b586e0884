"""Where rows come from: parquet tables, source trees, diffs."""
