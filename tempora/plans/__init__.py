"""Registered queries, their SQL counterparts, and the warehouse load."""
