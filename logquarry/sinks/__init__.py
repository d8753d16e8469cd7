"""Exports: every one writes JSON lines in parallel and returns how many it wrote."""
