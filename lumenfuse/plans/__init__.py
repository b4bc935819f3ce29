"""Batch jobs made of operators."""
