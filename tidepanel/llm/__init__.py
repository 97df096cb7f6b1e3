"""Operators for preparing training data: reading, cleaning, deduplicating, scoring, mixing, encoding."""
