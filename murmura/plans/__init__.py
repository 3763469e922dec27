"""Registered queries, their SQL counterparts and study plans."""
