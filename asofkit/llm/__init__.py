"""Training-data operators: sharding, joins, mixing, packing, search, scans and scoring."""
