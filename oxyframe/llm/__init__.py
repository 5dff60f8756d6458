"""Operators for large training corpora; nothing else in oxyframe imports this."""
