"""Column expressions: cleaning, amounts, facts."""
