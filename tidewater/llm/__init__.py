"""Training-data operators: quality, deduplication, filtering, mixing, formatting and scoring."""
