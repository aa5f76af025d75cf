"""Streaming of fieldloom."""
