"""Whole queries over the supplied tables, with the equivalent SQL."""
