"""Operators for building training data from the memory's texts and vectors."""
