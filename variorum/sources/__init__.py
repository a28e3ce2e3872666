"""sources of variorum."""
