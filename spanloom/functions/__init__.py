"""Column expressions of the engine."""
