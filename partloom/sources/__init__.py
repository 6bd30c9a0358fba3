"""Scans: text, CSV, PDF pages, presets, and their dispatch."""
