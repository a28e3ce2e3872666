"""plans of variorum."""
