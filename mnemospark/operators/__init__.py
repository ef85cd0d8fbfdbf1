"""Operators of the core engine, one module per family."""
