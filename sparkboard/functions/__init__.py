"""Column expressions and small helpers on names; nothing here starts a job."""
