"""evalframe operators."""
