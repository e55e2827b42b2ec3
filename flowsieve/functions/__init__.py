"""Column expressions: everything here builds a Column and runs no job."""
