"""Queries by inventory id over the logical views, with the SQL each is checked against."""
