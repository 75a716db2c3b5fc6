"""Runnable queries: the vault projection of the supplied tables, and operators applied to it."""
