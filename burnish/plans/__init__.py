"""Cleaning plans: lists of steps, run over a table with a record of what each step did."""
