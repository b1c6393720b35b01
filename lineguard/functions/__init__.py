"""Column expressions and the small per-row helpers that run inside Arrow tasks."""
