"""Operators for preparing training data: tokens, toxicity, deduplication, search, packing, secrets, mixing, pages."""
