"""Column helpers shared by the panel operators."""
