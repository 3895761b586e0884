"""Plan building blocks: lineage cuts, skew-safe joins, reachability, SPARQL."""
