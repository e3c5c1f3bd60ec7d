"""Relational operators of the engine, and the kernels of its sequential folds."""
