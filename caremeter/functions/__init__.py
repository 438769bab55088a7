"""Column rules: every function takes Columns (or names) and returns Columns."""
