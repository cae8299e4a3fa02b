"""Readers: tile archives, vector tiles, OSM extracts, boundary files, elevation tiles."""
