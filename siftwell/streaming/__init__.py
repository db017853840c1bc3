"""Siftwell streaming."""
