"""evalframe streaming."""
