"""Column functions that no single operator owns."""
