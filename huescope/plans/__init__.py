"""Registered queries with their adapters and SQL."""
