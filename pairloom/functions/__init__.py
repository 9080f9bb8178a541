"""Column expressions: fixed values, text, hashing and arrays."""
