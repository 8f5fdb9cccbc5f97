"""Key frequencies of streams."""
