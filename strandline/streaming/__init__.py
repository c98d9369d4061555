"""Continuous consumption with ledger-atomic checkpoints."""
