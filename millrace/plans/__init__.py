"""Whole dataflows put together from operators."""
