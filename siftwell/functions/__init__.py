"""Siftwell functions."""
