"""evalframe plans."""
