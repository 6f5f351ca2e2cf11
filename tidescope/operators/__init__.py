"""Operators over change data; each takes and returns DataFrames, and every "now" is an argument."""
