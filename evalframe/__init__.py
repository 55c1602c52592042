"""evalframe package."""
