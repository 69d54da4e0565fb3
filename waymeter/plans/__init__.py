"""Queries over the operators, and SQL to hold them against."""
