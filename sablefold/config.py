"""Configuration of a run, the user's own columns and retention."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from pathlib import Path

from .patterns import NAMES, PRESETS

MODES = ("fake", "redact", "shift", "perturb")
STYLES = ("full", "partial", "token", "typed-token")
STRATEGIES = ("exact", "normalized", "fuzzy")


@dataclass(frozen=True)
class Config:
    """How to find and replace personal data.

    ``sample_size`` None looks at all values of a column for shapes. ``anchor_date`` is the day from
    which fake ages count, so runs don't depend on today.
    """

    mode: str = "fake"
    redact_style: str = "typed-token"
    match_strategy: str = "normalized"
    seed: int = 0
    locale: str | None = None
    preset: str | None = None
    extra_pii_columns: tuple[str, ...] = ()
    override_defaults: bool = False
    json_columns: tuple[str, ...] = ()
    strict_paths: bool = False
    shift_days: int | None = None
    perturb_pct: float | None = None
    ner: bool = False
    value_detection: bool = True
    sample_size: int | None = None
    anchor_date: str = "2024-01-01"
    extra_patterns: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self) -> None:
        for value, known in ((self.mode, MODES), (self.redact_style, STYLES), (self.match_strategy, STRATEGIES)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")
        if self.preset and self.preset not in PRESETS:
            raise ValueError(f"unknown preset {self.preset!r}")

    def resolved(self) -> Config:
        """With the preset's locale and patterns and the mode that shift or perturb options imply."""
        out = self
        if self.preset:
            locale, patterns = PRESETS[self.preset]
            out = replace(out, locale=out.locale or locale, extra_patterns=(*out.extra_patterns, *patterns), preset=None)
        if out.mode == "fake" and out.shift_days is not None:
            out = replace(out, mode="shift")
        elif out.mode == "fake" and out.perturb_pct is not None:
            out = replace(out, mode="perturb")
        return out

    def patterns(self) -> list[tuple[str, str]]:
        """(pattern, category) in matching order: built-in ones, then the preset's, then the user's (category
        custom). Dotted extras are paths, not names."""
        own = [] if self.override_defaults else list(NAMES)
        extra = [(c, "custom") for c in self.extra_pii_columns if "." not in c]
        return [*own, *self.resolved().extra_patterns, *extra]

    @property
    def lossless(self) -> bool:
        """Whether every replacement leads back to one original."""
        return self.mode == "fake" or (self.mode == "redact" and self.redact_style in ("token", "typed-token"))


def user_file() -> Path:
    return Path(os.environ.get("SABLEFOLD_CONFIG", Path.home() / ".sablefold" / "config.yaml"))


def _load() -> dict:
    import yaml

    path = user_file()
    return (yaml.safe_load(path.read_text()) or {}) if path.exists() else {}


def _save(data: dict) -> None:
    import yaml

    path = user_file()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(data))


def user_columns() -> list[str]:
    """Columns that the user declared once for all runs."""
    return list(_load().get("extra_pii_columns", []))


def set_user_columns(columns: list[str]) -> None:
    _save(_load() | {"extra_pii_columns": list(dict.fromkeys(columns))})


def with_user_columns(config: Config) -> Config:
    return replace(config, extra_pii_columns=tuple(dict.fromkeys([*config.extra_pii_columns, *user_columns()])))


def retention_days() -> float | None:
    value = _load().get("mapping_retention")
    return parse_age(value) if value else None


def parse_age(text: str) -> float:
    """Days of an age such as 7d or 24h."""
    number, unit = text[:-1], text[-1:]
    if unit not in ("d", "h") or not number.replace(".", "", 1).isdigit():
        raise ValueError(f"{text!r} is no age; write 7d or 24h")
    return float(number) / (1 if unit == "d" else 24)
