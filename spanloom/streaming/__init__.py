"""Structured Streaming twins of the engine's folds."""
