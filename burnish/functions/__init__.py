"""Column expressions: Column in, Column out, no jobs, no Python in the tasks."""
