"""Sources of fieldloom."""
