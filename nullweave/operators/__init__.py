"""Operators of the null-model engine."""
