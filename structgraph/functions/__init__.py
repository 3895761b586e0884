"""Column expressions and Arrow functions shared by operators."""
