"""Operators for preparing training data: text quality, extraction, mixing, output."""
