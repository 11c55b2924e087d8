"""Operators over tables: views, profiles, differences, the SQL console."""
