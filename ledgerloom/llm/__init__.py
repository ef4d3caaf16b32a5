"""Training-data operators: scoring, filtering, deduplication and tokenisation of document tables."""
