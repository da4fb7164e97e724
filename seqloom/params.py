"""All tunable values of read correction in one record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    k: int = 17
    min_count: int = 3
    entropy: float = 0.6
    cluster_llh: float = -1.0
    do_em: bool = False
    thin_over: int = 0  # thin a cluster by the spectral filter only if it has more reads than this
    reuse_reads: bool = True
    strict_failures: bool = False  # True: a read past the failure limit is not gathered even if unclaimed
    restrict_failures: bool = True
    failure_limit: int = 3
    max_corrections: int = 5
    max_core_errors: int = 5
    max_pre_corrected_errors: int = 10
    pseudocount: float = 0.01
    emission_delta: float = 0.1
    read_low_complexity: float = 0.7
    kmer_low_complexity: float = 0.9
    rare_column: int = 3  # an error column counts if more reads than this err there
    column_cap: int = 200
    start: int | None = None
    end: int | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.k <= 31:
            raise ValueError("k must lie in 1..31")
        if not 0 <= self.failure_limit <= 255:
            raise ValueError("failure_limit must lie in 0..255")
