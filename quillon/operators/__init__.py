"""Operators over ledger tables; each takes and returns DataFrames."""
