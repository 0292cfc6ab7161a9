"""See the modules of this package."""
