"""Settings of the engine as frozen dataclasses, with overlays from mappings or YAML text, and the fixed word lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any

# Tags, word lists, weights and thresholds that results depend on.
RETRO_TAGS = ("marquee", "blink", "font", "center", "frameset")
SNIPPET_RETRO_TAGS = ("marquee", "blink", "font", "center")
ODD_KEYWORDS = ("webring", "guestbook", "bbs", "forum", "tilde", "topsites")
BORING_KEYWORDS = ("insurance", "mortgage", "terms and conditions", "privacy policy")
PREFILTER_KEYWORDS = ("insurance", "mortgage", "real estate")
ILLEGAL_KEYWORDS = ("child sexual abuse", "csam", "exploitative imagery", "illegal firearms marketplace", "human trafficking for sale")
CONTENT_TYPES = ("text/html", "application/xhtml+xml")
URL_SCHEMES = ("http", "https")
DANGER_CATEGORIES = ("self-harm", "illegal-trade", "adult", "extremist", "violent", "other")
CLASSIFIER_WEIGHTS = {"bias": -1.59, "text_density": 0.29, "retro_score": 0.04, "script_ratio": -0.35, "anchor_ratio": 0.75, "token_ratio": 3.01, "odd_keyword": 0.89}
FUSION_WEIGHTS = {"retro_html": 0.25, "url_weird": 0.10, "semantic": 0.30, "anomaly": 0.20, "graph": 0.15, "bias": 0.0}


@dataclass(frozen=True)
class CascadeSettings:
    max_content_length: int = 2_500_000
    min_content_length: int = 512
    snippet_bytes: int = 8192
    max_script_ratio: float = 0.55
    max_anchor_ratio: float = 0.65
    min_text_density: float = 0.02
    retro_override_score: float = 0.3
    density_token_override: int = 40
    density_anchor_override: float = 0.35
    density_skip_token_cap: int = 15
    classifier_threshold: float = 0.35
    classifier_weights: Mapping[str, float] = field(default_factory=lambda: dict(CLASSIFIER_WEIGHTS))
    odd_keywords: Sequence[str] = ODD_KEYWORDS
    boring_keywords: Sequence[str] = BORING_KEYWORDS
    content_types: Sequence[str] = CONTENT_TYPES
    simhash: bool = True


@dataclass(frozen=True)
class PrefilterSettings:
    enabled: bool = True
    min_token_count: int = 40
    max_same_domain_ratio: float = 0.9
    boring_keywords: Sequence[str] = PREFILTER_KEYWORDS
    odd_threshold: float = 0.55
    boring_threshold: float = 0.70

    @staticmethod
    def coerced(values: Mapping[str, Any]) -> PrefilterSettings:
        """Numbers may be strings, keywords a comma-separated string or a list; keywords are trimmed, and the first of equal ones (in any case) stays."""
        out: dict[str, Any] = {}
        for f in fields(PrefilterSettings):
            if f.name in values:
                v = values[f.name]
                if f.name == "boring_keywords":
                    given = v.split(",") if isinstance(v, str) else list(v)
                    kept: dict[str, str] = {}
                    for k in (str(x).strip() for x in given):
                        if k:
                            kept.setdefault(k.lower(), k)
                    v = tuple(kept.values())
                elif f.name == "enabled":
                    v = bool(v)
                else:
                    v = int(v) if f.name == "min_token_count" else float(v)
                out[f.name] = v
        return PrefilterSettings(**out)


def checked_centroids(rows: Sequence[Sequence[Any]]) -> list[list[float]]:
    """Centroids as lists of floats of one length; anything else is a ValueError."""
    out = [[float(x) for x in r] for r in rows if not isinstance(r, (str, bytes))]
    if len(out) != len(rows) or len({len(r) for r in out}) > 1 or any(not r for r in out):
        raise ValueError("centroids must be non-empty rows of numbers of one length")
    return out


@dataclass(frozen=True)
class FusionSettings:
    weights: Mapping[str, float] = field(default_factory=lambda: dict(FUSION_WEIGHTS))
    persist: float = 0.35
    llm_gate: float = 0.60
    alert: float = 0.80


@dataclass(frozen=True)
class FrontierSettings:
    weight_host_budget: float = 0.35
    weight_novelty: float = 0.25
    weight_bandit: float = 0.25
    weight_oddity: float = 0.15
    depth_penalty: float = 0.05
    novelty_decay: float = 6.0
    min_priority: float = 0.05
    max_priority: float = 1.0
    cross_domain_bonus: float = 0.05
    host_token_capacity: float = 1.0
    host_refill_seconds: float = 10.0
    host_penalty_seconds: float = 1.0
    failure_cooldown_seconds: float = 45.0
    bandit_initial: float = 0.6
    bandit_exploration: float = 0.25
    oddity_baseline: float = 0.5
    cascade_skip_threshold: float = 0.8
    cascade_penalty: float = 0.15
    cascade_min_observations: int = 5

    @staticmethod
    def derived(values: Mapping[str, Any] | None = None, per_host_rpm: float = 0.0) -> FrontierSettings:
        """A request rate sets the refill time, and the refill time the cooldown, where they aren't given."""
        given = dict(values or {})
        for short, name in (("host_budget", "weight_host_budget"), ("novelty", "weight_novelty"), ("bandit", "weight_bandit"), ("oddity_prior", "weight_oddity")):
            if short in given.get("weights", {}):
                given[name] = given["weights"][short]
        given.pop("weights", None)
        known = {f.name: given[f.name] for f in fields(FrontierSettings) if f.name in given}
        by_rate = 60.0 / per_host_rpm if per_host_rpm > 0 else float(known.get("host_refill_seconds", FrontierSettings.host_refill_seconds))
        known.setdefault("host_refill_seconds", by_rate)
        known.setdefault("failure_cooldown_seconds", max(3 * by_rate, FrontierSettings.failure_cooldown_seconds))
        return FrontierSettings(**{k: int(v) if k == "cascade_min_observations" else float(v) for k, v in known.items()})


def overlaid(settings, values: Mapping[str, Any]):
    """Settings with the known ones of ``values`` in place of their own."""
    return replace(settings, **{f.name: values[f.name] for f in fields(settings) if f.name in values})


def from_yaml(text: str) -> dict[str, Any]:
    """A YAML mapping (needs PyYAML; without it JSON, which is a subset, is read)."""
    try:
        import yaml

        got = yaml.safe_load(text)
    except ImportError:
        import json

        got = json.loads(text) if text.strip() else {}
    if got is not None and not isinstance(got, dict):
        raise ValueError("a configuration must be a mapping")
    return got or {}
