"""Siftwell plans."""
