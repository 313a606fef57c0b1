"""Column expressions: pitch, intervals, patterns, labels and metre."""
