"""Readers of tables, ledgers and text files."""
