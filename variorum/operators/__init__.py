"""operators of variorum."""
