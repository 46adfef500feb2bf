"""Iterative solves: driver loops over distributed sweeps."""
