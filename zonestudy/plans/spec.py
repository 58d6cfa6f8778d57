"""A study's rules as plain records: read, checked and hashed on the driver before any job runs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

from zonestudy.functions.expressions import check_expression, names_in
from zonestudy.functions.timeframe import seconds
from zonestudy.operators.scoring import ENTRIES, STOPS, TARGETS
from zonestudy.operators.touches import HTF_FIELDS, TRIGGERS

# The detectors' parameters and their defaults.
DEFAULTS: dict[str, dict[str, Any]] = {
    "order_block": {"displacement_atr": 1.5, "displacement_bars": 1, "require_swing_break": True, "swing_lookback": 10, "zone_from": "body", "max_age_bars": 500},
    "fvg": {"min_gap_atr": 0.25, "max_age_bars": 500},
    "swing_level": {"left": 5, "right": 5, "zone_pad_atr": 0.1, "max_age_bars": 1000},
    "prior_session_level": {"which": "high", "session": "RTH", "zone_pad_atr": 0.1, "max_age_bars": 1440},
    "round_number": {"step": 100.0, "zone_pad_atr": 0.1, "max_age_bars": 1440},
}


# The fields and defaults below are fixed values, too: they are those of the JSON form.
@dataclass
class ZoneRule:
    detector: str = "order_block"
    params: dict[str, Any] = field(default_factory=dict)

    def resolved(self) -> dict[str, Any]:
        return {**DEFAULTS[self.detector], **self.params}


@dataclass
class Htf:
    timeframe: str = ""
    ema_period: int = 50
    atr_period: int = 14
    slope_bars: int = 3


@dataclass
class Trigger:
    type: str = "touch"
    first_test_only: bool = True
    min_bars_after_formation: int = 1


@dataclass
class Stop:
    mode: str = "zone_far_edge"
    value: float = 1.0


@dataclass
class Target:
    mode: str = "r_multiple"
    value: float = 2.0


@dataclass
class Scoring:
    stop: Stop = field(default_factory=Stop)
    target: Target = field(default_factory=Target)
    max_holding_bars: int = 240
    entry: str = "zone_proximal"


def _read(kind: type, given: dict[str, Any] | None) -> Any:
    hints, given = get_type_hints(kind), given or {}
    known = {f.name: given[f.name] for f in fields(kind) if f.name in given}
    return kind(**{n: _read(hints[n], v) if is_dataclass(hints[n]) else v for n, v in known.items()})


@dataclass
class Spec:
    name: str = "untitled study"
    notes: str = ""
    symbol: str = ""
    timeframe: str = "5min"
    direction: str = "both"
    zone: ZoneRule = field(default_factory=ZoneRule)
    htf: Htf = field(default_factory=Htf)
    trigger: Trigger = field(default_factory=Trigger)
    filters: list[str] = field(default_factory=list)
    scoring: Scoring = field(default_factory=Scoring)

    @classmethod
    def from_dict(cls, given: dict[str, Any]) -> Spec:
        """Unknown entries are ignored, missing ones have their defaults."""
        return _read(cls, given)

    @classmethod
    def from_json(cls, text: str) -> Spec:
        return cls.from_dict(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    def fingerprint(self) -> str:
        """A hash of the rules; name and notes don't count."""
        rules = {k: v for k, v in asdict(self).items() if k not in ("name", "notes")}
        return hashlib.sha256(json.dumps(rules, sort_keys=True).encode()).hexdigest()[:16]

    def family(self) -> str:
        """What its holdout looks are counted under."""
        return "|".join([self.symbol or "*", self.zone.detector, self.direction])


def validate(spec: Spec) -> list[str]:
    """What keeps a spec from running, in words; empty when nothing does."""
    out: list[str] = []

    def one_of(label: str, value: Any, allowed: tuple[str, ...]) -> None:
        if value not in allowed:
            out.append(f"{label} is {value!r}; it must be one of {', '.join(allowed)}")

    def number(label: str, value: Any, least: float, above: bool = False) -> None:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            out.append(f"{label} is {value!r}; it must be a number")
        elif value < least or above and value == least:
            out.append(f"{label} is {value}; it must be {'above' if above else 'at least'} {least:g}")

    def length(label: str, value: str) -> int:
        try:
            return seconds(value)
        except ValueError as e:
            out.append(f"{label}: {e}")
            return 0

    one_of("zone.detector", spec.zone.detector, tuple(DEFAULTS))
    unknown = set(spec.zone.params) - set(DEFAULTS.get(spec.zone.detector, spec.zone.params))
    out.extend(f"zone.params: {spec.zone.detector} has no {p!r}" for p in sorted(unknown))
    one_of("direction", spec.direction, ("long", "short", "both"))
    one_of("trigger.type", spec.trigger.type, TRIGGERS)
    one_of("scoring.stop.mode", spec.scoring.stop.mode, STOPS)
    one_of("scoring.target.mode", spec.scoring.target.mode, TARGETS)
    one_of("scoring.entry", spec.scoring.entry, ENTRIES)
    number("trigger.min_bars_after_formation", spec.trigger.min_bars_after_formation, float("-inf"))
    number("scoring.max_holding_bars", spec.scoring.max_holding_bars, 1)
    number("scoring.stop.value", spec.scoring.stop.value, 0, above=True)
    number("scoring.target.value", spec.scoring.target.value, float("-inf") if spec.scoring.target.mode == "none" else 0, above=True)
    own = length("timeframe", spec.timeframe)
    if spec.htf.timeframe:
        higher = length("htf.timeframe", spec.htf.timeframe)
        if own and higher and higher <= own:
            out.append(f"htf.timeframe {spec.htf.timeframe} must be longer than timeframe {spec.timeframe}")
    else:
        higher_names = {*HTF_FIELDS, "htf_bar_progress", "aligned", "aligned_bar"}
        used = sorted({n for f in spec.filters for n in names_in(f)} & higher_names)
        if used:
            out.append(f"{', '.join(used)} in a filter: htf.timeframe is empty")
    out.extend(f"filter {f!r}: {e}" for f in spec.filters if (e := check_expression(f)))
    return out
