"""Sessions, shipped code, scratch tables."""
