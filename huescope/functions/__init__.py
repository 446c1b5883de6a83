"""Column expressions: colour, geometry and verdicts."""
