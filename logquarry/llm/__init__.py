"""Operators for preparing training text: cleaning, deduplication, tokens, sharding, mixing, labels."""
