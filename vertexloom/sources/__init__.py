"""Graph files: text, binary and tables."""
