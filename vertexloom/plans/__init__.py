"""Iteration: supersteps, fixpoints and lineage cuts."""
