"""streaming of variorum."""
