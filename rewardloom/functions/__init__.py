"""Column expressions: text extraction, number normalisation, vectors, domains."""
