"""Scalar functions, time-based UUIDs, partition tokens."""
