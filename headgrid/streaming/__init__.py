"""Structured Streaming jobs over change feeds and drop folders."""
