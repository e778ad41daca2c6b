"""DataFrame operators: detection, scoring and ledger workflow."""
