"""Scalar expressions over pixels."""
