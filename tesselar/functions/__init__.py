"""Part of the spatial engine."""
