"""functions of variorum."""
