"""DataFrame operators: validation, keys, references, reports."""
