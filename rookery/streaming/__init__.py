"""Structured Streaming jobs that keep votes, notifications and daily actives fresh."""
