"""Training-data operators: formatting, sharding, tokenising, cleaning and deduplicating text corpora."""
