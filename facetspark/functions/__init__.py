"""Column-level geometry."""
