"""Streaming of the null-model engine."""
