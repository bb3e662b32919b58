"""Operators over live streams."""
