"""Connected components of a graph held as an edge table: the library's own, for every node that has an edge."""

from __future__ import annotations

from shoebox.operators.graph import linked as components

__all__ = ["components"]
