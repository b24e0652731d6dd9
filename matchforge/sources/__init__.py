"""Readers of tables and files."""
