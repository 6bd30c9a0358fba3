"""Relational operators over part events and inventories."""
