"""Relational and numeric operators over long tables."""
