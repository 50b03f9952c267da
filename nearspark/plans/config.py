"""Index options, build plans, search parameters and the rules that fill in automatic values."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

TYPES = ("ivf_flat", "ivf_sq", "ivf_pq", "ivf_rq", "diskann")
METRICS = ("l2", "inner_product", "cosine")
SEED = 1234
#: Graph presets: max degree, build list, alpha, raw encoding, build distance. Fixed values.
PRESETS = {"fast": (48, 64, 1.15, "f16", "pq"), "balanced": (64, 100, 1.2, "f16", "pq"), "high": (96, 200, 1.2, "f32", "full")}
#: Names of options. Fixed values.
KEYS = frozenset(
    "index.type dimension metric nlist expected-vector-count target-recall max-bytes-per-vector max-build-seconds deployment-profile pq.m pq.code-ratio pq.bits use-opq rq.bits "
    "diskann.build-preset diskann.seed diskann.memory-budget-bytes diskann.max-degree diskann.build-search-list-size diskann.alpha diskann.storage-layout diskann.raw-vector-encoding diskann.build-distance".split()
)


def infer_nlist(n: int) -> int:
    """The power of two nearest to sqrt(n) (ties down), at most n // 64 rounded down to one, at least 1."""
    if n < 1:
        raise ValueError("the vector count must be positive")
    cap = 1 << max(0, (max(1, n // 64)).bit_length() - 1)
    low = 1 << int(math.isqrt(n).bit_length() - 1)
    return max(1, min(cap, low if math.sqrt(n) - low <= 2 * low - math.sqrt(n) else 2 * low))


def infer_nprobe(nlist: int, n: int, k: int, matching: int | None = None, cap: int | None = None) -> int:
    """Lists to probe for k neighbours of n vectors; more where a filter leaves ``matching`` of them."""
    if matching == 0:
        return 1
    each = -(-max(n, 1) // nlist)
    base = min(nlist, max(8, -(-nlist // 16), -(-4 * k // each)))
    if matching is None or matching >= n:
        return base
    grown = min(nlist, -(-base * n // matching))
    if cap is not None and cap <= 0:
        raise ValueError("the filter-expansion cap must be positive")
    return grown if cap is None else min(grown, base * cap)


def infer_l_search(k: int) -> int:
    return max(2 * k, 100)


def infer_rq_bits(d: int, budget: int) -> int:
    padded = -(-d // 64) * 64
    for bits in range(8, 0, -1):
        if padded * bits // 8 + (8 if bits == 1 else 20) <= budget:
            return bits
    raise ValueError("no bit width fits the budget")


def infer_pq_m(d: int, bits: int = 8, ratio: float = 0.0625) -> int:
    return min(d, max(1, math.floor(d * 32 * ratio / bits + 0.5)))


def infer_uniform_pq_m(d: int, bits: int = 8, ratio: float = 0.0625) -> int:
    """The divisor of d nearest to infer_pq_m, ties up."""
    m = infer_pq_m(d, bits, ratio)
    return min((x for x in range(1, d + 1) if d % x == 0), key=lambda x: (abs(x - m), -x))


def training_count(n: int, nlist: int) -> int:
    return min(n, max(65_536, 64 * nlist))


def recommend_index(n: int, bytes_per_vector: int | None = None, remote: bool = False, recall: float | None = None) -> str:
    if n <= 100_000:
        return "ivf_flat"
    if bytes_per_vector is not None and bytes_per_vector <= 32:
        return "ivf_pq"
    if remote:
        return "ivf_rq"
    return "diskann" if recall is not None and recall >= 0.95 else "ivf_sq"


def nlist_for_partition(n: int, target: int) -> int:
    return min(65_536, max(1, n // max(1, target)))


def bytes_per_vector(config: IndexConfig) -> float:
    """Estimated stored bytes of a row, ids of 8 bytes included."""
    d = config.dimension
    payload = {"ivf_flat": 4 * d, "ivf_sq": d, "ivf_pq": config.pq_m * config.pq_bits / 8, "ivf_rq": -(-d // 64) * 8 * config.rq_bits + 12}
    graph = 4 * config.max_degree + d * (2 if config.raw_encoding == "f16" else 4) + config.pq_m * config.pq_bits / 8
    return 8 + payload.get(config.index_type, graph)


@dataclass(frozen=True)
class IndexConfig:
    index_type: str
    dimension: int
    metric: str = "l2"
    nlist: int = 1
    pq_m: int = 1
    pq_bits: int = 8
    use_opq: bool = False
    rq_bits: int = 4
    max_degree: int = 64
    build_l: int = 100
    alpha: float = 1.2
    seed: int = SEED
    raw_encoding: str = "f16"
    build_distance: str = "pq"
    storage_layout: str = "compact"
    memory_budget: int = 8 << 30

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.index_type in TYPES, f"unknown index type {self.index_type!r}")
        need(self.metric in METRICS, f"unknown metric {self.metric!r}")
        need(self.dimension > 0 and self.nlist > 0, "dimension and nlist must be positive")
        if self.index_type == "ivf_pq":
            need(self.pq_m > 0 and self.dimension % self.pq_m == 0, "pq.m must divide the dimension")
        if self.index_type == "ivf_rq":
            need(1 <= self.rq_bits <= 8, "rq.bits must be 1 to 8")
        if self.index_type == "diskann":
            need(self.dimension <= 1024 and 1 <= self.max_degree <= 1023 and self.build_l >= self.max_degree, "graph sizes out of bounds")
            need(self.pq_m > 0, "pq.m must be positive")
            need(math.isfinite(self.alpha) and self.alpha >= 1 and self.pq_m <= self.dimension and self.pq_bits in (4, 8), "graph options out of bounds")

    @classmethod
    def from_options(cls, options: Mapping[str, str]) -> IndexConfig:
        if "max-build-seconds" in options:
            raise ValueError("max-build-seconds belongs to a build plan")
        return BuildPlan.from_options(options).config

    def resolved(self) -> dict:
        return self.__dict__ | {"bytes_per_vector": bytes_per_vector(self)}


@dataclass(frozen=True)
class BuildPlan:
    config: IndexConfig
    expected: int | None = None
    objective: dict = field(default_factory=dict)

    @classmethod
    def from_options(cls, options: Mapping[str, str]) -> BuildPlan:
        """Trimmed keys, no duplicates, no unknown or unused ones, values case-sensitive."""
        own: dict[str, str] = {}
        for k, v in options.items():
            if (k := k.strip()) in own:
                raise ValueError(f"duplicate option {k!r}")
            if k not in KEYS:
                raise ValueError(f"unknown option {k!r}")
            own[k] = str(v).strip()
        used: set[str] = set()

        def take(key: str, kind=str, default=None):
            used.add(key)
            if key not in own:
                return default
            if kind is bool:
                if own[key] not in ("true", "false"):
                    raise ValueError(f"{key} must be true or false")
                return own[key] == "true"
            return kind(own[key])

        for key in ("index.type", "dimension", "metric"):
            if key not in own:
                raise ValueError(f"missing option {key!r}")
        kind, d, metric = take("index.type"), take("dimension", int), take("metric")
        n, recall, most = take("expected-vector-count", int), take("target-recall", float), take("max-bytes-per-vector", int)
        objective = {"target_recall": recall, "max_bytes_per_vector": most, "max_build_seconds": take("max-build-seconds", float), "profile": take("deployment-profile")}
        values: dict = {"index_type": kind, "dimension": d, "metric": metric}
        if kind in TYPES and kind != "diskann":
            given = take("nlist", str)
            if given in (None, "auto"):
                if n is None:
                    raise ValueError("nlist needs expected-vector-count")
                values["nlist"] = infer_nlist(n)
            else:
                values["nlist"] = int(given)
        if kind == "ivf_pq":
            ratio = take("pq.code-ratio", float, 0.0625)
            given = take("pq.m", int)
            values["pq_m"] = infer_uniform_pq_m(d, 8, ratio) if given is None else given
            values["use_opq"] = take("use-opq", bool, recall is not None and recall >= 0.9)
        if kind == "ivf_rq":
            given = take("rq.bits", int)
            values["rq_bits"] = given if given is not None else infer_rq_bits(d, most - 10) if most is not None else 4
        if kind == "diskann":
            preset = take("diskann.build-preset") or ("high" if recall is not None and recall >= 0.97 else "fast" if recall is not None and recall <= 0.85 else "balanced")
            if preset not in PRESETS:
                raise ValueError(f"unknown preset {preset!r}")
            r, l, alpha, raw, by = PRESETS[preset]
            bits = take("pq.bits", int, 8)
            values |= {
                "pq_bits": bits, "pq_m": m if (m := take("pq.m", int)) is not None else infer_pq_m(d, bits, take("pq.code-ratio", float, 0.0625)), "seed": take("diskann.seed", int, 42),
                "max_degree": take("diskann.max-degree", int, r), "build_l": take("diskann.build-search-list-size", int, l), "alpha": take("diskann.alpha", float, alpha),
                "raw_encoding": take("diskann.raw-vector-encoding", str, raw), "build_distance": take("diskann.build-distance", str, by),
                "storage_layout": take("diskann.storage-layout", str, "compact"), "memory_budget": take("diskann.memory-budget-bytes", int, 8 << 30),
            }
            used.add("pq.code-ratio")
        if unused := set(own) - used:
            raise ValueError(f"options that {kind} doesn't have: {sorted(unused)}")
        config = IndexConfig(**values)
        if most is not None and bytes_per_vector(config) > most:
            raise ValueError(f"{bytes_per_vector(config):.0f} bytes a vector; at most {most} are wanted")
        return cls(config, n, objective)


@dataclass(frozen=True)
class SearchParams:
    k: int
    nprobe: int | None = None  # None: automatic, with progressive expansion
    l_search: int | None = None
    max_filter_expansion: int | None = None

    def __post_init__(self):
        for name in ("k", "nprobe", "l_search", "max_filter_expansion"):
            if (v := getattr(self, name)) is not None and v <= 0:
                raise ValueError(f"{name} must be positive")
        if self.max_filter_expansion is not None and self.nprobe is not None:
            raise ValueError("the filter-expansion cap needs an automatic width")

    @classmethod
    def automatic(cls, k: int) -> SearchParams:
        return cls(k)

    @classmethod
    def ivf(cls, k: int, nprobe: int) -> SearchParams:
        return cls(k, nprobe=nprobe)

    @classmethod
    def diskann(cls, k: int, l_search: int) -> SearchParams:
        return cls(k, l_search=l_search)

    def with_(self, **changes) -> SearchParams:
        return replace(self, **changes)
