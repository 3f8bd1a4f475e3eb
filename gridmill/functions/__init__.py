"""Column expressions and quantile jobs with one fixed meaning each."""
