"""Keyed upserts, result documents, exports and text writers."""
