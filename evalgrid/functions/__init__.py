"""Scalar functions of the scorer: activations, losses, penalties."""
