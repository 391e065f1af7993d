"""Continuous forms of the batch measures."""
