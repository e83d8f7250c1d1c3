"""Structured Streaming surface, beyond what batch operators need."""
