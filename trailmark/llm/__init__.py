"""Operators that prepare training text: quality, privacy, duplicates, mixing, tokens."""
