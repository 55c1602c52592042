"""evalframe sources."""
