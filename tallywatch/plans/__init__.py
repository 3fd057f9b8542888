"""Queries over the test tables: one per operator, with the SQL that checks it."""
