"""Connected components, shared with the rest of the library."""

from strandline.operators.components import components

__all__ = ["components"]
