"""Registered queries: which operator runs over which tables, and the SQL that must agree."""
