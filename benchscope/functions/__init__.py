"""Column-level helpers (no actions, no data movement)."""
