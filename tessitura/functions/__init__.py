"""Column expressions: names of persons, keys, formats."""
