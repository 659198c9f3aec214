"""Connected components by rounds of contraction, as the library has them."""

from __future__ import annotations

from corpusloom.operators.components import contracted as components

__all__ = ["components"]
