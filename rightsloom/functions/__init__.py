"""Column functions: text, vocabulary, bytes."""
