"""Strandline: ordered ledger-event analytics on Spark."""
