"""Cleaning operators: every one takes a DataFrame and gives a new one."""
