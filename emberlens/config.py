"""Settings of the flow analysis."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class FlowConfig:
    """Segmentation, clustering, baseline, detection and ranking settings; times in milliseconds."""

    strategy: str = "idle_gap"
    entry_sites: tuple[str, ...] = ()
    terminal_sites: tuple[str, ...] = ()
    idle_gap_ms: int = 5_000
    correlation_pattern: str | None = None
    signature_k: int = 3
    min_cluster_size: int = 10
    cluster_ceiling: int = 200
    window_start: int | None = None
    window_end: int | None = None
    eval_start: int | None = None
    eval_end: int | None = None
    alternatives: int = 5
    timing_factor: float = 3.0
    censor_margin_ms: int | None = None
    rarity_weight: float = 1.0
    severity_weight: float = 1.0
    error_weight: float = 0.5
    magnitude_weight: float = 0.5
    cluster_size_weight: float = 0.5
    benign_variant_penalty: float = 0.2
    top_n: int = 20
    suppressions: tuple[Mapping[str, str | None], ...] = field(default=())

    @staticmethod
    def from_mapping(m: Mapping[str, Any]) -> FlowConfig:
        """From the sections of a configuration document, already read into mappings."""
        names = {
            "segmentation": {"strategy": "strategy", "entryCallSites": "entry_sites", "terminalCallSites": "terminal_sites", "idleGapMillis": "idle_gap_ms", "correlationIdPattern": "correlation_pattern"},
            "clustering": {"signatureK": "signature_k", "minClusterSize": "min_cluster_size", "clusterCeiling": "cluster_ceiling"},
            "baseline": {"alternatives": "alternatives"},
            "detection": {"timingFactor": "timing_factor", "censorMarginMillis": "censor_margin_ms"},
            "ranking": {"benignVariantPenalty": "benign_variant_penalty", "topN": "top_n"},
        }
        got: dict[str, Any] = {}
        for section, keys in names.items():
            part = m.get(section) or {}
            got |= {ours: part[theirs] for theirs, ours in keys.items() if theirs in part}
        weights = (m.get("ranking") or {}).get("weights") or {}
        got |= {f"{ours}_weight": weights[k] for k, ours in (("rarity", "rarity"), ("severity", "severity"), ("error", "error"), ("magnitude", "magnitude"), ("clusterSize", "cluster_size")) if k in weights}
        for key, prefix in (("window", "window"), ("evalWindow", "eval")):
            w = (m.get("baseline") or {}).get(key) or {}
            got |= {f"{prefix}_{side}": w[side] for side in ("start", "end") if w.get(side) is not None}
        kinds = {f.name: f.type for f in fields(FlowConfig)}
        return FlowConfig(**{k: tuple(v) if kinds[k].startswith("tuple") else v for k, v in got.items()})
