"""Reports composed from rollups."""
