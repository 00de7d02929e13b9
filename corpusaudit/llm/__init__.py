"""Operators for preparing training text: counting, cleaning, deduplicating, formatting, packing."""
