"""Column expressions: text, numbers, times, labels."""
