"""Scope-partitioned change data on Spark: membership, change logs, deltas, snapshots, writes and checksums as DataFrame operations."""
