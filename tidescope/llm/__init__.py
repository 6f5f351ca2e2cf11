"""Operators for preparing training data: near and exact copies, leaks, toxicity, tokens and shards."""
