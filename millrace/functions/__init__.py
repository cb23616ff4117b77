"""Column expressions with the engine's rules for missing values, numbers and nested cells."""
