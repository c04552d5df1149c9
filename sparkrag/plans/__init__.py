"""Registered queries over the given tables, with equivalent SQL."""
