"""Operators for training data: mixing, near and exact duplicates, licences, benchmark leaks, tokens, toxicity."""
