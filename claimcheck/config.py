"""Pipeline settings: frozen dataclasses, checked when they are built."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from types import MappingProxyType

from claimcheck.rules import policy
from claimcheck.rules.cues import BENGALI, CuePack

QUERY_MODES = ("prompt", "prompt_response")
ROUTING_MODES = ("static", "model", "hybrid")
HYPOTHESIS_STYLES = ("answer_only", "qa_en", "qa_bn", "claim_bn")


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _unit(name: str, value: float) -> None:
    _require(0.0 <= value <= 1.0, f"{name} must lie in [0, 1], got {value}")


@dataclass(frozen=True)
class RouterConfig:
    enabled: bool = True
    mode: str = "hybrid"
    cues: CuePack = BENGALI

    def __post_init__(self) -> None:
        _require(self.mode in ROUTING_MODES, f"routing mode must be one of {ROUTING_MODES}")


@dataclass(frozen=True)
class RetrievalConfig:
    sources: tuple[str, ...] = policy.SOURCES
    top_k: int = 5
    threshold: float = 0.55
    max_evidence_tokens: int | None = None
    query_mode: str = "prompt"

    def __post_init__(self) -> None:
        _require(len(self.sources) > 0, "at least one source is needed")
        _require(self.top_k > 0, "top_k must be positive")
        _require(self.query_mode in QUERY_MODES, f"query_mode must be one of {QUERY_MODES}")
        _unit("threshold", self.threshold)


@dataclass(frozen=True)
class ThinkConfig:
    enabled: bool = True
    force_all: bool = False
    low: float = 0.30
    high: float = 0.70
    max_tokens: int = 768
    max_tokens_by_task: Mapping[str, int] = field(
        default_factory=lambda: MappingProxyType(dict(policy.THINK_TOKENS))
    )

    def __post_init__(self) -> None:
        _unit("low", self.low)
        _unit("high", self.high)
        _require(self.low <= self.high, "low must not exceed high")


@dataclass(frozen=True)
class NliConfig:
    enabled: bool = True
    tasks: tuple[str, ...] = policy.NLI_TASKS
    margin: float = 0.35
    margin_faithful: float = 0.45
    margin_hallucinated: float = 0.30
    hypothesis_style: str = "qa_en"
    faithful_score: float = 0.90
    hallucinated_score: float = 0.10
    require_overlap: bool = True
    overlap_min: float = 0.4
    require_entail_over_neutral: bool = True
    block_on_fast_disagreement: bool = True
    fast_max_for_faithful: float = 0.40
    min_retrieval_similarity: float = 0.55

    def __post_init__(self) -> None:
        _require(
            self.hypothesis_style in HYPOTHESIS_STYLES,
            f"hypothesis_style must be one of {HYPOTHESIS_STYLES}",
        )


@dataclass(frozen=True)
class PipelineConfig:
    router: RouterConfig = field(default_factory=RouterConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    think: ThinkConfig = field(default_factory=ThinkConfig)
    nli: NliConfig = field(default_factory=NliConfig)
    threshold: float = 0.5
    exemplar_top_k: int = 0
    scorer_name: str = "lexical"
    scorer_mode: str = "column"
    run_timestamp: str = "19700101_000000"

    def __post_init__(self) -> None:
        _unit("threshold", self.threshold)
        _require(self.exemplar_top_k >= 0, "exemplar_top_k must not be negative")

    def cache_metadata(self) -> dict[str, str]:
        """Settings that can change a score; a cached score is valid only if all agree.

        ``force_all`` is included on purpose, it changes which rows are thought over.
        """
        nli = asdict(self.nli)
        nli["tasks"] = ",".join(sorted(self.nli.tasks))
        think = {
            "enabled": self.think.enabled,
            "force_all": self.think.force_all,
            "low": self.think.low,
            "high": self.think.high,
            "max_tokens": self.think.max_tokens,
            "max_tokens_by_task": ",".join(
                f"{k}:{v}" for k, v in sorted(self.think.max_tokens_by_task.items())
            ),
        }
        meta = {
            "scorer_name": self.scorer_name,
            "scorer_mode": self.scorer_mode,
            "exemplar_top_k": self.exemplar_top_k,
        }
        meta.update({f"think_{k}": v for k, v in think.items()})
        if self.nli.enabled:
            meta.update({f"nli_{k}": v for k, v in nli.items()})
        else:
            meta["nli_enabled"] = False
        return {k: str(v) for k, v in sorted(meta.items())}

    def meta_hash(self) -> str:
        text = "\n".join(f"{k}={v}" for k, v in self.cache_metadata().items())
        return hashlib.sha256(text.encode("utf-8")).hexdigest()
