"""Queries put together from several operators."""
