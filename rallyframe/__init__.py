"""Part of rallyframe."""
