"""Passes over a table that several operators share."""
