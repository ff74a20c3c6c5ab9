"""Relational graph operators: every graph is a nodes and an edges DataFrame."""
