"""Column expressions on text, and the topic model."""
