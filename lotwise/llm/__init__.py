"""Operators for preparing training text: filters, duplicate detection, search, packing."""
