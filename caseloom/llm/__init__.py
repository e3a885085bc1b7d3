"""Training-data operators: deduplication, filtering, mixing and token output."""
