"""Directory streams of rasters."""
