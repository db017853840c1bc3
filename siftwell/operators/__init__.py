"""Siftwell operators."""
