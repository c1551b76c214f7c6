"""Structured Streaming over segment receipts."""
