"""Readers: batch files, event tables, trace records, media sidecars, named sources."""
