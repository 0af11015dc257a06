"""Parameters of the two entry points, validated on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WINDOW_SIZE, N_CHANNELS = 2000, 20
#: The ten signals of a strand in the order of their channels.
SIGNALS = ("DEL_cigar", "INS_cigar", "DEL_split", "INS_split", "INV_split", "DUP_split", "BND_split", "clip_ms", "clip_sm", "depth")
HEADS = ("cnn_mamba", "cnn", "mamba")


@dataclass(frozen=True)
class GenerateConfig:
    contigs: tuple[str, ...] = ()
    region: int = 10_000_000
    subregion: int | None = None
    feature_dtype: str = "float16"
    overwrite: bool = False

    def __post_init__(self):
        if self.feature_dtype not in ("float16", "float32"):
            raise ValueError(f"unknown feature type {self.feature_dtype!r}")


@dataclass(frozen=True)
class CallConfig:
    contigs: tuple[str, ...] = ()
    threshold: float | None = None
    head: str = "auto"
    geno_method: str = "loggl"
    max_dup_inv_len: int = 2_000_000
    support_scale: float = 1.0
    support_cap: int = 0
    predict_only: bool = False
    cluster_only: bool = False
    refine: bool = False
    refine_types: tuple[str, ...] = ("DEL",)
    refine_window: int = 200
    refine_min_evidence: int = 2
    refine_max_shift: int = 500
    bands: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.predict_only and self.cluster_only:
            raise ValueError("predict_only and cluster_only exclude each other")
        if self.geno_method not in ("loggl", "vote"):
            raise ValueError(f"unknown genotyping {self.geno_method!r}")
        if self.threshold is not None and not 0 <= self.threshold <= 1:
            raise ValueError("a threshold lies between 0 and 1")


def resolve_threshold(given: float | None, meta: dict) -> float:
    """What is given, else the metadata's, else 0.5."""
    if given is not None:
        if not 0 <= given <= 1:
            raise ValueError("a threshold lies between 0 and 1")
        return float(given)
    return float(meta.get("decision_threshold", 0.5))


def resolve_head(given: str, meta: dict) -> str:
    head = given if given != "auto" else meta.get("ablation", {}).get("eval_head", HEADS[0])
    return head if head in HEADS else HEADS[0]


def parse_contigs(text: str | None) -> tuple[str, ...]:
    """Names from "[a,b]" or "a,b"; nothing means all."""
    return tuple(x for x in (p.strip().strip("'\"") for p in re.sub(r"^\[|\]$", "", (text or "").strip()).split(",")) if x)


def parse_refine_types(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t.strip().upper() for t in text.split(",") if t.strip()))


def infer_channels(flat_length: int, window: int = WINDOW_SIZE) -> int:
    if flat_length % window:
        raise ValueError(f"{flat_length} values are no whole windows of {window}")
    return flat_length // window


# ---------------------------------------------------------------- feature specifications
def feature_spec(version: str = "legacy20") -> dict:
    """A known version of the features of a window."""
    if version != "legacy20":
        raise ValueError(f"unknown feature version {version!r}")
    names = [f"{signal.lower()}_{strand}" for strand in ("rev", "fwd") for signal in SIGNALS]
    return {"feature_version": version, "feature_dim": len(names), "window_size": WINDOW_SIZE, "channel_names": names, "normalization": "zscore"}


def normal_spec(given: dict) -> dict:
    """A specification with all its fields; names and dimension have to agree, and a version that is no inferred one has to be known."""
    dim, window = int(given["feature_dim"]), int(given.get("window_size", WINDOW_SIZE))
    names = list(given.get("channel_names") or [f"feature_{k}" for k in range(dim)])
    if len(names) != dim:
        raise ValueError(f"{len(names)} channel names for {dim} channels")
    version = str(given.get("feature_version", f"inferred_{dim}d"))
    if not version.startswith("inferred_"):
        feature_spec(version)
    return {"feature_version": version, "feature_dim": dim, "window_size": window, "channel_names": names, "normalization": str(given.get("normalization", "unknown"))}


def inferred_spec(flat_length: int, window: int = WINDOW_SIZE) -> dict:
    """The known specification of that many values a window, else one without names."""
    dim, known = infer_channels(flat_length, window), feature_spec()
    return known if (dim, window) == (known["feature_dim"], known["window_size"]) else normal_spec({"feature_dim": dim, "window_size": window})


def resolve_spec(data: dict | None, weights: dict | None, default: str = "legacy20") -> dict:
    """The data's specification over the weights', else one of them, else the default version; window and dimension have to agree."""
    data, weights = (normal_spec(x) if x else None for x in (data, weights))
    if data and weights:
        for key in ("feature_dim", "window_size"):
            if data[key] != weights[key]:
                raise ValueError(f"{key} is {data[key]} in the data and {weights[key]} in the weights")
    return (weights or {}) | data if data else weights or feature_spec(default)
