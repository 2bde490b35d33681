"""Profiles, issues and scores of tables."""
