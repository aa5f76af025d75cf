"""Functions of fieldloom."""
