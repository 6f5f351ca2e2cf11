"""Scalar functions: portable types, canonical rows, versions, conflict resolution, cursors and error codes."""
