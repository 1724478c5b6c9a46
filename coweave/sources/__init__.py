"""Readers, writers and the stand-in tables that tests and queries use."""
