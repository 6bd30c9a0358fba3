"""Operators for preparing large text corpora. Nothing outside this folder imports it."""
