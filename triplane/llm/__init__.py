"""Training-data operators: packing, filters, deduplication, scoring, sharding and token files."""
