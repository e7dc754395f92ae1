"""Plans of the null-model engine."""
