"""Verbs over signal frames."""
