"""Column functions: text folding, similarity, dates, guarded arithmetic."""
