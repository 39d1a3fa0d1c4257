"""Column expressions: key hashing and bound arithmetic."""
