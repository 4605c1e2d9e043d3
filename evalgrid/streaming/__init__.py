"""Racing: partial scores by chunk with early exit, and the same over a stream."""
