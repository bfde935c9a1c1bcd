"""Column functions on text and targets."""
