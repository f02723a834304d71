"""Physical helpers (materialising, skew-safe joins) and the query catalogue."""
