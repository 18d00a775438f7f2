"""Scoring settings: genre profiles, weights, strictness, and their discovery in TOML files."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from plumbline.rules import ALL_IDS, RANKS, REWRITES, Rule

#: Dimensions in scan order, which is also the order of findings that start together.
DIMENSIONS = (
    "cadence_sameness", "formatting_tells", "formulaic_structure", "human_writing_signals", "lexical_markers",
    "significance_inflation", "weasel_attribution", "unsupported_claims", "prompt_residue", "redundancy",
    "genericity", "superficial_analysis", "parallelism", "copula_avoidance",
)
HUMAN = "human_writing_signals"
BIAS = -2.6
#: In the order in which contributions are added up.
WEIGHTS = {
    "prompt_residue": 4.5, "significance_inflation": 2.8, "superficial_analysis": 2.8, "formulaic_structure": 2.6,
    "weasel_attribution": 2.0, "unsupported_claims": 1.6, "genericity": 1.6, "redundancy": 1.2, "cadence_sameness": 0.9,
    "formatting_tells": 0.8, "copula_avoidance": 1.4, "parallelism": 1.6, "lexical_markers": 2.2, HUMAN: -2.2,
}
#: Dimensions whose contribution is damped when no other one is elevated.
WEAK = ("copula_avoidance", "formatting_tells", "lexical_markers", "parallelism")
LONE_WEAK, ELEVATED = 0.3, 0.5
GAINS = {"conservative": 0.8, "balanced": 1.0, "sensitive": 1.25}
PROFILES: dict[str, dict[str, float]] = {
    "blog": {"cadence_sameness": 0.8, "unsupported_claims": 1.1, "formulaic_structure": 1.2, "genericity": 1.2, "significance_inflation": 1.2},
    "essay": {"genericity": 1.1, "parallelism": 1.1, "redundancy": 1.2},
    "academic": {"copula_avoidance": 0.7, "formulaic_structure": 0.9, "lexical_markers": 0.8, "weasel_attribution": 0.8},
    "marketing": {"copula_avoidance": 0.6, "formatting_tells": 0.7, "genericity": 0.8, "lexical_markers": 0.7, "significance_inflation": 0.8},
    "technical": {"cadence_sameness": 0.7, "copula_avoidance": 0.5, "lexical_markers": 0.7, "parallelism": 0.8},
    "social": {"formatting_tells": 0.6},
}
#: Logistic model: bias, weight by dimension, and the two numbers of its calibration.
MODEL_BIAS, MODEL_A, MODEL_B = -1.229113, 1.711665, 0.225975
MODEL = {
    "lexical_markers": 2.423948, "formulaic_structure": 0.96163, "genericity": 1.158032, "cadence_sameness": 0.0,
    "redundancy": 0.0, "prompt_residue": 0.002262, "significance_inflation": 0.0, "weasel_attribution": 0.971715,
    "superficial_analysis": 0.835917, "parallelism": 0.288047, "copula_avoidance": 0.717118,
    "unsupported_claims": 1.244943, "formatting_tells": 0.0, HUMAN: -0.562469,
}
CAVEATS = (
    "The score measures how a text is written, not who or what wrote it.",
    "Formal and second-language writing can score higher without fault.",
    "Don't take decisions about people on this score alone.",
)


@dataclass(frozen=True)
class Settings:
    """What a scan depends on. Unknown profiles have no multipliers; invalid severities are refused at once."""

    profile: str = "blog"
    strictness: str = "conservative"
    scorer: str = "rules"
    min_reliable_words: int = 300
    disabled_dimensions: frozenset[str] = frozenset()
    disabled_rules: frozenset[str] = frozenset()
    rule_severity: dict[str, str] = field(default_factory=dict)
    suggest: bool = False
    #: Prefix of control comments, as in ``<!-- plumbline-disable-line -->``.
    comment_prefix: str = "plumbline"
    #: Straighten curly quotes and repair text before anything is counted.
    repair: bool = True
    #: Rules beside the catalogue's, as rules.load_rules() reads them from files.
    extra_rules: tuple[Rule, ...] = ()

    def __post_init__(self) -> None:
        if self.strictness not in GAINS:
            raise ValueError(f"strictness must be one of {sorted(GAINS)}, not {self.strictness!r}")
        if self.scorer not in ("rules", "ml"):
            raise ValueError(f"scorer must be rules or ml, not {self.scorer!r}")
        if bad := sorted(set(self.rule_severity.values()) - set(RANKS)):
            raise ValueError(f"severity must be one of {sorted(RANKS)}, not {bad}")

    def multiplier(self, dimension: str) -> float:
        return PROFILES.get(self.profile, {}).get(dimension, 1.0)

    @property
    def known_names(self) -> frozenset[str]:
        return frozenset((*DIMENSIONS, *ALL_IDS, *(r.rule.rule_id for r in REWRITES), *(r.rule_id for r in self.extra_rules)))


_KEYS = {f.name for f in fields(Settings)} - {"extra_rules"}
_SETS = ("disabled_dimensions", "disabled_rules")


def discover(start: str | Path, name: str = "plumbline") -> Path | None:
    """The nearest ``<name>.toml``, or ``pyproject.toml`` with a table for it, in start or above it."""
    here = Path(start).resolve()
    for folder in (here, *here.parents) if here.is_dir() else here.parents:
        if (own := folder / f"{name}.toml").is_file():
            return own
        if (project := folder / "pyproject.toml").is_file() and name in tomllib.loads(project.read_text()).get("tool", {}):
            return project
    return None


def load(path: str | Path, name: str = "plumbline") -> dict[str, Any]:
    """Known keys of the file; those of a ``<name>.toml`` win over a ``pyproject.toml`` beside it."""
    path, out = Path(path), {}
    for p in (path.parent / "pyproject.toml", path):
        if p.is_file():
            data = tomllib.loads(p.read_text())
            own = data.get("tool", {}).get(name, {}) if p.name == "pyproject.toml" else data.get(name, data)
            out |= {k.replace("-", "_"): v for k, v in own.items() if k.replace("-", "_") in _KEYS}
    return out


def resolve(flags: dict[str, Any] | None = None, file: dict[str, Any] | None = None) -> Settings:
    """Flags over file over defaults; a flag that is None isn't given. Lists must not be bare strings."""
    given = dict(file or {}) | {k: v for k, v in (flags or {}).items() if v is not None}
    for k in _SETS:
        if k in given:
            if isinstance(given[k], str):
                raise ValueError(f"{k} must be a list of names")
            given[k] = frozenset(given[k])
    return replace(Settings(), **given)
