"""Relational and retrieval operators as DataFrame transformations."""
