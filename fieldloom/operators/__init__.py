"""Operators of fieldloom."""
