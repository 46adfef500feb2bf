"""Operators on DataFrames: distributions, transport on a line, power diagrams, densities, indices, tensors."""
