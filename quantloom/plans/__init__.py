"""Formula trees compiled to columns, and the factor catalogue."""
