"""Operators for preparing text to train language models on, their queries and the SQL that checks them."""
