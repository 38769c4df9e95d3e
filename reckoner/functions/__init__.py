"""Part of the expense-report engine; see README."""
