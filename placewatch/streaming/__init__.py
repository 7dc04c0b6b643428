"""Structured Streaming forms: landing ingest, daily roll-up, newest row per key."""
