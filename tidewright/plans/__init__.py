"""Registered queries and their DuckDB forms."""
