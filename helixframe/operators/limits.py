"""Parameters that make no sense, and limits whose excess is an error and never a shorter result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


class LimitError(ValueError):
    """A stated limit was exceeded."""


@dataclass(frozen=True)
class Parameters:
    """k of 3 to 127, qualities up to 93, a support of at least 1 (2 where retained k-mers must recur), flanks of at least 1."""

    k: int = 31
    minimum_quality: int = 20
    minimum_support: int = 2
    unit: str = "fragment"
    flank: int = 12
    max_candidates: int = 1000

    def __post_init__(self) -> None:
        rules = [
            (3 <= self.k <= 127, "k must be 3 to 127"),
            (0 <= self.minimum_quality <= 93, "a quality must be 0 to 93"),
            (self.minimum_support >= 1, "support must be at least 1"),
            (self.unit in ("fragment", "occurrence"), "unit is 'fragment' or 'occurrence'"),
            (self.flank >= 1, "a flank must have a base"),
            (self.max_candidates >= 1, "max_candidates must be at least 1"),
        ]
        wrong = [text for holds, text in rules if not holds]
        if wrong:
            raise ValueError("; ".join(wrong))


def multi_k(ks: list[int]) -> list[int]:
    """Several k in order: at least two, rising, each of 3 to 127."""
    if len(ks) < 2 or sorted(set(ks)) != list(ks):
        raise ValueError("give two k or more, in rising order")
    return [Parameters(k=k).k for k in ks]


def at_most(rows: DataFrame, limit: int, what: str) -> DataFrame:
    """The same rows; an error if there are more than `limit`. Counts no further than one beyond."""
    if rows.limit(limit + 1).count() > limit:
        raise LimitError(f"more than {limit} {what}")
    return rows


def pair_evidence_state(fragments: DataFrame, paired: bool, max_fragments: int) -> str:
    """available, not_paired_input, or unavailable_fragment_limit where more fragments were supplied than pairs are evaluated for."""
    if not paired:
        return "not_paired_input"
    return "unavailable_fragment_limit" if fragments.limit(max_fragments + 1).count() > max_fragments else "available"
