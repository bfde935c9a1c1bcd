"""Sources of raw events and tables."""
