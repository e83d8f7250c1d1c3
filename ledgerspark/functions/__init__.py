"""Column expressions: amounts, periods, finance."""
