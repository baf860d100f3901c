"""Column expressions and the parameter formulas."""
