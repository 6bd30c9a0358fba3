"""Column expressions: values, references, search terms, fixed knowledge."""
