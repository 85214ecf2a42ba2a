"""Registered queries over the test tables, and the same answers in plain SQL."""
