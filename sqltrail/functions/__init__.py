"""Column expressions; nothing here needs a Python worker."""
