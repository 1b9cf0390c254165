"""Rule-based labels as native expressions."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bottleneck labels in the order they are tested.
CPU_BOUND = "CPU-bound"
IO_BOUND = "IO-bound"
PX_INTENSIVE = "PX-intensive"
PLAN_CHANGE_RISK = "Plan-change-risk"
LOW_IMPACT = "Low-impact"
MIXED = "Mixed/Other"

# Health limits in percent.
CPU_WARNING = 80
CPU_CRITICAL = 90
CACHE_HIT_MINIMUM = 90


def bottleneck_labels(available: Collection[str]) -> Column:
    """All labels of an aggregated SQL row; a missing column counts as zero."""
    names = {c.lower() for c in available}

    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in names else F.lit(0.0)

    cpu, elapsed, execs = value("total_cpu_s"), value("total_elapsed_s"), value("total_execs")
    rules = [
        (CPU_BOUND, (elapsed > 0) & (F.try_divide(cpu, elapsed) > 0.7) & (cpu > 10)),
        (IO_BOUND, (value("total_io_wait_s") > 10)
         & ((value("total_read_mb") > 100) | (value("total_physical_read_gb") > 1.0))),
        (PX_INTENSIVE, value("total_direct_w_gb") > 5.0),
        (PLAN_CHANGE_RISK, (value("max_plan_changes") > 0) | (value("plans_seen") > 1)),
        (LOW_IMPACT, (elapsed < 10) & (cpu < 5) & (execs < 10)),
    ]
    hits = F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in rules]))
    return F.when(F.size(hits) == 0, F.array(F.lit(MIXED))).otherwise(hits)


def cpu_status(c: Column | str) -> Column:
    cpu = F.col(c) if isinstance(c, str) else c
    return (
        F.when(cpu.isNull(), F.lit(None).cast("string"))
        .when(cpu > CPU_CRITICAL, "critical")
        .when(cpu > CPU_WARNING, "warning")
        .otherwise("healthy")
    )


def cache_status(c: Column | str) -> Column:
    hit = F.col(c) if isinstance(c, str) else c
    return F.when(hit.isNull(), F.lit(None).cast("string")).when(hit < CACHE_HIT_MINIMUM, "memory issue").otherwise("healthy")
