"""Connected components of a distributed edge list: the library's."""

from __future__ import annotations

from skein.operators.graph import components

__all__ = ["components"]
