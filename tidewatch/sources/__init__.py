"""Readers: captures, name feeds, lookups and ledger tables, all at rest."""
