"""Operators: k-mers, sketches, distances, simulated mutants."""
