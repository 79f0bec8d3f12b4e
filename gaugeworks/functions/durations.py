"""Durations as text: 500ms, 10s, 5m, 2h, 7d; a bare number means seconds in settings."""

from __future__ import annotations

import re

UNITS_US = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
LIMIT = 2**63 - 1


def parse_duration(text: str | int | float, bare_seconds: bool = False) -> int:
    """Microseconds; ValueError for bad text or a value beyond 63 bits."""
    if isinstance(text, (int, float)) and not isinstance(text, bool):
        if not bare_seconds:
            raise ValueError(f"duration needs a unit: {text!r}")
        value = round(text * 1_000_000)
    else:
        m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h|d)?\s*", str(text))
        if not m or (m[2] is None and not bare_seconds):
            raise ValueError(f"not a duration: {text!r}")
        value = int(m[1]) * UNITS_US[m[2] or "s"]
    if not 0 <= value <= LIMIT:
        raise ValueError(f"duration out of range: {text!r}")
    return value
