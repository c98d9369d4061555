"""Schemas, value decoding and argument checks."""
