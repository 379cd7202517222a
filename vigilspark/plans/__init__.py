"""Registered queries, each paired with the SQL that checks it."""
