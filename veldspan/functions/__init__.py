"""Column expressions: references, confidence, formats."""
