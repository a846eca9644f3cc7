"""Encodings of values and times, their display and comparison as column expressions."""
