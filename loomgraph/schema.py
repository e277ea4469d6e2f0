"""Schemas of the graph tables and the rule tables of manifest validation."""

from __future__ import annotations

#: The edge types and their weights when taken from hints.
EDGE_WEIGHT = {"REQUIRES": 1.0, "CONFLICTS_WITH": 1.0, "ENHANCES": 0.8, "SUBSTITUTES": 0.9}
#: Hint keys and the edge types they declare.
HINT_TYPES = {"requires": "REQUIRES", "conflicts_with": "CONFLICTS_WITH", "enhances": "ENHANCES", "substitutes": "SUBSTITUTES"}

#: Formats of manifest fields.
SKILL_ID = r"^[a-z0-9_-]+:[a-z0-9_-]+$"
PERMISSION = r"^[a-z]+:[a-z]+(:[a-zA-Z0-9_/.-]+)?$"
