"""Operators for preparing training text: scoring, filtering, de-duplicating, scanning and mixing documents."""
