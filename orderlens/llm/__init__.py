"""Training-data operators: dedup, tokenizing, mixing, filtering and scans over document tables."""
