"""Column expressions: span sets, sizes, run-log JSON."""
