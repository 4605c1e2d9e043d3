"""Training-data operators: text cleaning, deduplication, scoring, filtering and encoding over Spark tables."""
