"""Declarative parser specifications, compiled to columns."""
