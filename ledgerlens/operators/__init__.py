"""DataFrame -> DataFrame operators.  ``keys`` selects the per-account grain."""
