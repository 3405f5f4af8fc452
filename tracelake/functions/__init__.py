"""Column expressions: dose metrics, curves, text parsers."""
