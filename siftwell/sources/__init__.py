"""Siftwell sources."""
