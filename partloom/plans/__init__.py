"""Whole queries composed of sources and operators."""
