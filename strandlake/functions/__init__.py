"""Column expressions: ranges, fold change, descriptions and sequences."""
