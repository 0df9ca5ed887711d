"""Settings of the engine: frozen dataclasses, read from JSON, with named profiles on top."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class Coding:
    """Codes: m projections of lam bits each, in tables x divisions."""

    m: int = 24
    lam: int = 2
    divisions: int = 3
    tables: int = 6
    seed: int = 13
    omega_divisor: float = 2.5
    sample_size: int = 1000
    min_sample: int = 1000
    block: int = 64

    def __post_init__(self):
        for name in ("m", "lam", "divisions", "tables"):
            object.__setattr__(self, name, max(1, getattr(self, name)))


@dataclass(frozen=True)
class Search:
    """Query limits. cap None stands for hard_cap, 0 turns the candidate cap off; threshold 0 the Hamming threshold."""

    refinement_limit: int = 20000
    cap: int | None = None
    max_candidates: int = 20000
    probes: int = 5
    retry_probes: int = 10
    retry_factor: int = 10
    threshold: int = 0

    @property
    def hard_cap(self) -> int:
        return max(self.max_candidates, self.refinement_limit)


@dataclass(frozen=True)
class Evaluation:
    k_variants: tuple[int, ...] = (1, 10, 20, 40, 60, 80, 100)
    ratio_source: str = "gt"
    gt_sample: int = 100
    gt_tolerance: float = 0.10


@dataclass(frozen=True)
class Rotation:
    enabled: bool = True
    max_operations: int = 500_000_000
    max_age_ms: int = 86_400_000
    keep: int = 5


@dataclass(frozen=True)
class Config:
    coding: Coding = field(default_factory=Coding)
    search: Search = field(default_factory=Search)
    evaluation: Evaluation = field(default_factory=Evaluation)
    rotation: Rotation = field(default_factory=Rotation)

    def validate(self) -> Config:
        if self.search.max_candidates < max(self.evaluation.k_variants):
            raise ValueError("max_candidates is below the largest k")
        return self

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


#: Names of settings in JSON files, by section, and ours.
JSON_NAMES = {
    "paper": ("coding", {"m": "m", "lambda": "lam", "divisions": "divisions", "tables": "tables", "seed": "seed"}),
    "runtime": ("search", {"refinementLimit": "refinement_limit", "maxGlobalCandidates": "max_candidates", "probeOverride": "probes", "hammingPrefilterThreshold": "threshold"}),
    "eval": ("evaluation", {"kVariants": "k_variants"}),
    "ratio": ("evaluation", {"source": "ratio_source", "gtSample": "gt_sample", "gtMismatchTolerance": "gt_tolerance"}),
    "reencryption": ("rotation", {"enabled": "enabled"}),
}


def _apply(config: Config, data: dict) -> Config:
    for section, (part, names) in JSON_NAMES.items():
        found = {ours: data[section][theirs] for theirs, ours in names.items() if theirs in (data.get(section) or {})}
        if "probes" in found and found["probes"] <= 0:
            del found["probes"]
        if "k_variants" in found:
            found["k_variants"] = tuple(found["k_variants"])
        config = replace(config, **{part: replace(getattr(config, part), **found)})
    return config


def load(text: str, profile: str | None = None) -> Config:
    """Reads JSON; unknown keys are ignored. A profile's sections override the file's."""
    data = json.loads(text)
    config = _apply(Config(), data)
    if profile is not None:
        chosen = [p for p in data.get("profiles", []) if p.get("name") == profile]
        if not chosen:
            raise KeyError(f"no profile {profile}")
        config = _apply(config, chosen[0].get("overrides", chosen[0]))
    return config.validate()


assert all(f.name in ("coding", "search", "evaluation", "rotation") for f in fields(Config))
