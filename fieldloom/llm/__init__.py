"""Preparation of large training and matching data; nothing outside this package imports it."""
