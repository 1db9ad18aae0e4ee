"""Preparation of content scripts as training data: quality, duplicates, leaks, mixing, sharding."""
