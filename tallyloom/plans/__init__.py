"""Registered queries, their SQL, and helpers that cut lineage."""
