"""Extract, transform, validate, load as one lazy plan with counts taken on the way."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.operators.quality import ERRORS, Rule, Schema, check, invalid_rows, valid_rows
from gleaner.session import cut_lineage

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class EtlResult:
    """What a run did. The frames are lazy and read the checkpointed rows."""

    success: bool = False
    records_processed: int = 0
    records_valid: int = 0
    records_invalid: int = 0
    records_loaded: int = 0
    started: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    duration: float = 0.0
    error_message: str | None = None
    valid: DataFrame | None = None
    invalid: DataFrame | None = None


@dataclass
class Etl:
    """Stages are frames to frames; ``load`` is called once, and only if a row is valid."""

    extract: Callable[[], DataFrame]
    transforms: Sequence[Stage] = ()
    schema: Schema | None = None
    rules: Sequence[Rule] = ()
    load: Callable[[DataFrame], None] | None = None
    quarantine: Callable[[DataFrame], None] | None = None

    def plan(self) -> DataFrame:
        """All rows with their error array; nothing runs."""
        df = self.extract()
        for stage in self.transforms:
            df = df.transform(stage)
        return check(df, self.rules, self.schema)

    def run(self, dry: bool = False) -> EtlResult:
        """Failures are reported, not raised. Both sinks read the checkpointed rows, so sources are read once."""
        result, clock = EtlResult(), time.monotonic()
        try:
            seen = Observation("gleaner_etl")
            rows = cut_lineage(self.plan().observe(
                seen, F.count(F.lit(1)).alias("processed"), F.count_if(F.size(ERRORS) == 0).alias("valid")
            ))
            counts = seen.get
            result.records_processed = counts["processed"]
            result.records_valid = counts["valid"]
            result.records_invalid = counts["processed"] - counts["valid"]
            result.valid, result.invalid = valid_rows(rows), invalid_rows(rows)
            if not dry:
                if self.load is not None and result.records_valid:
                    self.load(result.valid)
                    result.records_loaded = result.records_valid
                if self.quarantine is not None and result.records_invalid:
                    self.quarantine(result.invalid)
            result.success = True
        except Exception as exc:  # reported in the result
            result.error_message = str(exc)
        result.duration = time.monotonic() - clock
        return result

    def dry_run(self) -> EtlResult:
        return self.run(dry=True)


def stats(checked: DataFrame) -> DataFrame:
    """``records_processed, records_valid, records_invalid`` of checked rows as one row."""
    ok = F.size(ERRORS) == 0
    return checked.agg(
        F.count("*").alias("records_processed"),
        F.count_if(ok).alias("records_valid"),
        F.count_if(~ok).alias("records_invalid"),
    )
