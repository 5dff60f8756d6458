"""Operators that need no future rows, over Structured Streaming."""
