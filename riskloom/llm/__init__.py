"""Operators for preparing training corpora: language, quality, duplicates, tokens and packing."""
