"""Column-level functions: values, JSON Schema keywords, formats, key paths."""
