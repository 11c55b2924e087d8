"""Queries over the star schema that show the operators, with their SQL."""
