"""Relational operators over scans, symbols, hierarchies, findings and repairs."""
