"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

CLASSIFICATION, REGRESSION = "classification", "regression"


@dataclass
class Settings:
    target_table: str
    target_ids: list[str]
    targets: list[str]
    target_date: str | None = None
    task: Literal["classification", "regression"] = CLASSIFICATION
    #: Temporal window: rows from lead + lag before the base date to lead before it, in units.
    unit: Literal["year", "month", "day", "hour", "minute", "second"] = "year"
    lag: int = 100
    lead: int = 0
    max_depth: int = 10
    #: Most frequent values that value patterns are bound to.
    value_count: int = 20
    #: Rows of each class (or all rows, in regression) that the sample keeps; None keeps all.
    sample_count: int | None = None
    #: Best features kept for each target, and columns that a main sample may have.
    predictor_max: int = 100
    column_budget: int = 250
    least_relevance: float = 1e-4
    #: Rows of one key from which a join deals them over salts.
    heavy_key_rows: int = 1_000_000
    folds: int = 10
    seed: int = 1
    use_ids: bool = False
    table_white: list[str] = field(default_factory=list)
    table_black: list[str] = field(default_factory=list)
    column_white: list[str] = field(default_factory=list)
    column_black: list[str] = field(default_factory=list)
    pattern_white: list[str] = field(default_factory=list)
    pattern_black: list[str] = field(default_factory=list)
    #: Patterns of the second, experimental tier.
    experimental: bool = False
    #: Seconds that computing and scoring one fused set of features may take; None is no limit.
    seconds_limit: float | None = None
    #: Expressions in one fused aggregation: beyond this, code generation gives up.
    fuse_width: int = 120
