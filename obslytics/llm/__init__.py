"""Training-data operators: scoring, sharding, scanning, deduplication, indexing, packing, redaction."""
