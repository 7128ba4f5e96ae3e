"""Connected components, as the core has them: hubs by broadcast, bounded rounds, written tables."""

from __future__ import annotations

from quarry.operators.graph import components as connected_components

__all__ = ["connected_components"]
