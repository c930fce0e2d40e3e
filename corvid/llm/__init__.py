"""Training-data operators: tokenising, filtering, de-duplicating, packing, sharding and archiving text at scale."""
