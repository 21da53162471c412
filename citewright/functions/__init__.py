"""See the README for what is in this package."""
