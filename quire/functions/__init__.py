"""Column functions: text, JSON values, phrase tables."""
