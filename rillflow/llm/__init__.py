"""Training-data operators: scoring, deduplication, tokenisation, filtering and packing."""
