"""Analyzers: tables of metrics, and the findings drawn from them."""
