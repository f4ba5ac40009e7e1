"""Settings of the analysis."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Policy:
    """Limits of the final selection; the defaults are fixed values of the service that this engine answers for."""

    max_text: int = 100_000
    single_chunk: int = 4_500
    chunk_target: int = 3_000
    chunk_overlap: int = 250
    min_confidence: float = 0.55
    min_confidence_style: float = 0.75
    min_confidence_other: float = 0.7
    near_distance: int = 8
    style_quota: int = 9_999
    other_quota: int = 2
    enable_style: bool = True
    enable_other: bool = True
    max_change_ratio: float = 0.06
    style_per_1k: int = 3
    style_ratio: float = 0.15
    paragraph_cap: int = 1
    allowed_kinds: tuple[str, ...] = ("whitespace", "punctuation", "case")
    max_replacement: int = 400
    small_edit: int = 1_200

    def with_settings(self, settings: Mapping[str, str], prefix: str = "proselens.") -> Policy:
        """This policy with what a job's settings (Spark properties, environment) say under their prefix, as text."""
        read = {bool: lambda x: x.strip().lower() in ("1", "true", "yes", "on"), int: int, float: float, tuple: lambda x: tuple(w.strip() for w in x.split(",") if w.strip())}
        given = {f.name: read[type(getattr(self, f.name))](settings[prefix + f.name]) for f in fields(self) if prefix + f.name in settings}
        return replace(self, **given)


DEFAULT = Policy()
CATEGORIES = ("spacing", "punctuation", "spelling", "style", "other")
SEVERITIES = ("info", "warn", "error")
DIFF_KINDS = ("whitespace", "punctuation", "case", "wording")
