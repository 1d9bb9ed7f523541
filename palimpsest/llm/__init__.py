"""Operators for preparing training corpora: dedup, archives, quality, packing, privacy, formatting, sharding."""
