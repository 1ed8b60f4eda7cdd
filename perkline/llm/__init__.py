"""Operators for preparing training text: packing, files, duplicates, scoring and rules."""
