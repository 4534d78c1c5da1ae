"""Operators for training data: splitting, deduplicating, naming, packing,
mixing and span search. Nothing outside this subpackage imports it."""
