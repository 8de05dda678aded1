"""Column-to-Column functions: text, numbers, code, replies, budgets."""
