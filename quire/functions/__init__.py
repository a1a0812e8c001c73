"""Column expressions, vocabularies and model hooks."""
