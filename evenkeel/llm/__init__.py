"""Operators for preparing training text: deduplication, filtering, scanning, sampling and packing."""
