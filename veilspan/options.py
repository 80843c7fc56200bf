"""Scan options, fixed on the driver before a plan is built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from .rules.catalogue import Rule
from .rules.table import select_rules

MODES = ("redact", "block", "warn")
ACTIONS = ("block", "redact", "warn", "ignore")


def _strings(value) -> tuple[str, ...]:
    return tuple(str(v) for v in value if isinstance(v, str)) if isinstance(value, (list, tuple)) else ()


@dataclass(frozen=True)
class ScanOptions:
    mode: str = "redact"
    entropy_enabled: bool = True
    entropy_threshold: float = 4.0
    entropy_action: str = "warn"
    disabled: tuple[str, ...] = ()
    custom: tuple[Rule, ...] = ()
    allow_paths: tuple[str, ...] = ()
    allow_patterns: tuple[str, ...] = ()
    # Word of the inline pragma ("# veilspan: allow") and first word of every placeholder.
    pragma: str = "veilspan"
    prefix: str = "MASKED"
    # Stop after this many matches of one rule in one text; None keeps every match.
    match_limit: int | None = None
    rules: tuple[Rule, ...] = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.entropy_action not in ACTIONS:
            raise ValueError(f"entropy_action must be one of {ACTIONS}")
        object.__setattr__(self, "rules", select_rules(self.disabled, self.custom))

    def but(self, **changes) -> "ScanOptions":
        return replace(self, **changes)

    @classmethod
    def from_mapping(cls, raw: Mapping | None, custom: tuple[Rule, ...] = ()) -> "ScanOptions":
        """Lenient reading of a configuration mapping: values of the wrong kind fall back."""
        raw = raw if isinstance(raw, Mapping) else {}
        base = cls()

        def section(name: str) -> Mapping:
            value = raw.get(name)
            return value if isinstance(value, Mapping) else {}

        def choice(value, allowed, fallback):
            return value if value in allowed else fallback

        entropy, allow = section("entropy"), section("allowlist")
        enabled, threshold = entropy.get("enabled"), entropy.get("threshold")
        numeric = isinstance(threshold, (int, float)) and not isinstance(threshold, bool)
        return cls(
            mode=choice(raw.get("mode"), MODES, base.mode),
            entropy_enabled=enabled if isinstance(enabled, bool) else base.entropy_enabled,
            entropy_threshold=float(threshold) if numeric else base.entropy_threshold,
            entropy_action=choice(entropy.get("action"), ACTIONS, base.entropy_action),
            disabled=_strings(section("rules").get("disable")),
            custom=tuple(custom),
            allow_paths=_strings(allow.get("paths")),
            allow_patterns=_strings(allow.get("patterns")),
        )
