"""Scanning, format detection and loaders."""
