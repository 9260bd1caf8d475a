"""Training-data operators: scoring, near-duplicate search, packing, mixing and archives."""
