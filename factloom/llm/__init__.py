"""Corpus operators for training data: each module has one operator and its registered query."""
