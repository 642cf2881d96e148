"""Reading and writing the extracts."""
