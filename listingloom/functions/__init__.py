"""Column rules used by the jobs; each takes and returns columns."""
