"""Resolution profiles: thresholds that trade precision for recall."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Profile:
    """One profile; ratios lie in 0..1 and tiers don't rise.

    ``allow_soft_matches``, ``require_business_relationship``,
    ``min_confidence_for_merge``, ``use_hard_links_only``,
    ``ignore_low_quality_evidence``, ``min_attribute_match_ratio`` and the third
    tier are validated and carried, but decide nothing.
    """

    name: str = "default"
    description: str = ""
    merge_threshold: float = 0.5
    min_attribute_match_ratio: float = 0.3
    hard_link_tier1_ratio: float = 0.5
    hard_link_tier2_ratio: float = 0.3
    hard_link_tier3_ratio: float = 0.3
    allow_soft_matches: bool = False
    require_business_relationship: bool = False
    min_confidence_for_merge: float = 0.7
    use_hard_links_only: bool = False
    ignore_low_quality_evidence: bool = False
    output_suffix: str = ""
    output_description: str = ""

    def __post_init__(self) -> None:
        for name in ("merge_threshold", "min_attribute_match_ratio", "hard_link_tier1_ratio", "hard_link_tier2_ratio", "hard_link_tier3_ratio", "min_confidence_for_merge"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie between 0 and 1, not {getattr(self, name)}")
        if not self.hard_link_tier1_ratio >= self.hard_link_tier2_ratio >= self.hard_link_tier3_ratio:
            raise ValueError("hard link tiers must not rise: tier 1 >= tier 2 >= tier 3")

    def __str__(self) -> str:
        return f"{self.name} (merge >= {self.merge_threshold})"


# The thresholds of the three shipped profiles.
DEFAULT = Profile()
OPERATIONAL = Profile(name="operational", merge_threshold=0.85, hard_link_tier1_ratio=0.8, hard_link_tier2_ratio=0.6, hard_link_tier3_ratio=0.4, output_suffix="_operational")
ANALYTICS = Profile(name="analytics", merge_threshold=0.4, hard_link_tier1_ratio=0.4, hard_link_tier2_ratio=0.2, hard_link_tier3_ratio=0.1, output_suffix="_analytics")
BUILT_IN = {p.name: p for p in (DEFAULT, OPERATIONAL, ANALYTICS)}


def list_profiles(folder: str | None = None) -> list[str]:
    """Sorted names of the profiles in a folder of ``resolution_<name>.yaml`` files.

    Without a folder, the built-in names; a missing folder has none.
    """
    if folder is None:
        return sorted(BUILT_IN)
    return sorted(p.stem.removeprefix("resolution_") for p in Path(folder).glob("resolution_*.yaml"))


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in ("'", '"'):
        return text[1 : text.index(text[0], 1)]
    text = text.split(" #")[0].strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    try:
        return float(text)
    except ValueError:
        return text


def load_profile(name: str = "default", folder: str | None = None) -> Profile:
    """A profile by name, from a folder of YAML files or from the built-in ones.

    The files are flat ``key: value`` mappings; keys a profile doesn't have are
    ignored.  Raises FileNotFoundError for an unknown name.
    """
    if folder is None:
        if name not in BUILT_IN:
            raise FileNotFoundError(f"no profile {name!r}; there are {', '.join(sorted(BUILT_IN))}")
        return BUILT_IN[name]
    path = Path(folder) / f"resolution_{name}.yaml"
    if not path.exists():
        raise FileNotFoundError(f"no profile {name!r} in {folder}; there are {', '.join(list_profiles(folder))}")
    known = {f.name for f in fields(Profile)}
    pairs = (line.split(":", 1) for line in path.read_text().splitlines() if ":" in line and not line.lstrip().startswith("#"))
    values = {k.strip(): _scalar(v) for k, v in pairs if k.strip() in known}
    values.setdefault("name", name)
    values.setdefault("output_suffix", "" if name == "default" else f"_{name}")
    return Profile(**values)
