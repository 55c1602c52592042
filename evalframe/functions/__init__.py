"""evalframe functions."""
