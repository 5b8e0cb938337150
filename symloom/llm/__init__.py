"""Operators for preparing training data: packing, token files, language, shards, duplicates, leaks, filters, search."""
