"""Training-data operators: extraction, deduplication, mixing, filtering, search."""
