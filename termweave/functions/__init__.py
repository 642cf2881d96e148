"""Column expressions. No function here runs a job or calls Python per row."""
