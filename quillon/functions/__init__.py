"""Column expressions: text, SQL text, schema text and exact rounding."""
