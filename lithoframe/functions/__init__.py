"""Column expressions: undefined is NULL, never NaN."""
