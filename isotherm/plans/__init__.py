"""Whole queries over the operators, with the SQL they are held against."""
