"""Sources of the null-model engine."""
