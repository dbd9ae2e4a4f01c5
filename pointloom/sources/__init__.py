"""Readers: every format becomes a table with a declared schema."""
