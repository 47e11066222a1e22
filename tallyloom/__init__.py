"""Tallyloom: usage-ledger analytics and corpus operators as lazy DataFrame transforms."""
