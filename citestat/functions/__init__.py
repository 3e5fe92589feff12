"""Column functions: every function takes Columns (or names) and returns a Column."""
