"""Functions of the null-model engine."""
