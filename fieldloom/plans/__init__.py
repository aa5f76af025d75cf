"""Plans of fieldloom."""
