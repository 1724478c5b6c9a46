"""Registered queries: each applies library operators to the test tables and names its SQL equivalent."""
