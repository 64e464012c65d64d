"""Structured Streaming forms of the serving and monitoring operators (STR-1..4)."""
