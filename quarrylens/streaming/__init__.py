"""Progress of a running analysis."""
