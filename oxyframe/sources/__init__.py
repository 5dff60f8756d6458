"""Readers of device exports."""
