"""Column expressions: money, dates, gate, residuals, text checks."""
