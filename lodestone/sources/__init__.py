"""Readers, writers and collection stores."""
