"""Readers, rasters and writers."""
