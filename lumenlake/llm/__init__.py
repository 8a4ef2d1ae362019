"""Training-data operators: cleaning, deduplication, mixing, tokenising and sharding of documents."""
