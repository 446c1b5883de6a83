"""Relational and per-frame operators."""
