"""Column expressions; nothing here starts a job or needs a shuffle."""
