"""Bar lengths as text: a number with a unit, or a unit alone."""

from __future__ import annotations

import re

_UNITS = {"s": 1, "sec": 1, "second": 1, "min": 60, "minute": 60, "t": 60, "m": 60, "h": 3600, "hr": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800}


def seconds(timeframe: str) -> int:
    """``15min`` -> 900, ``1h30min`` -> 5400. Raises ValueError for text that names no length above zero."""
    parts = re.findall(r"(\d+(?:\.\d+)?)?\s*([a-zA-Z]+?)s?(?![a-zA-Z])\s*", (timeframe or "").strip())
    whole = re.fullmatch(r"(?:\d+(?:\.\d+)?\s*[a-zA-Z]+\s*)+|[a-zA-Z]+", (timeframe or "").strip())
    lengths = [float(n or 1) * _UNITS.get(unit.lower(), 0) for n, unit in parts]
    total = sum(lengths)
    if not whole or not lengths or min(lengths) <= 0 or total != int(total):
        raise ValueError(f"{timeframe!r} is not a length of time in whole seconds")
    return int(total)
