"""Connected components of a link table, which collation has too."""

from variorum.operators.components import components

__all__ = ["components"]
