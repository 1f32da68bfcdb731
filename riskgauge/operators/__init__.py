"""DataFrame -> DataFrame operators by family."""
