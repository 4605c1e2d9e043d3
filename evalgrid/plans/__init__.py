"""Creature graphs, their evaluation order, and the two forms of the forward pass."""
