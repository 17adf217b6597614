"""Incremental forms of the operators, each equal to its batch twin after any number of batches."""
