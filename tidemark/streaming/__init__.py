"""Structured Streaming: change capture into ledgers, raw archives and windowed repeats."""
