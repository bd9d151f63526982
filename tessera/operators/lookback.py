"""Look-back counts: for each probe row, the distinct events of the same key
whose time lies in ``[probe_time - window, probe_time]``.

This is the correlated subquery

    (SELECT COUNT(DISTINCT e.id) FROM events e
      WHERE e.key = p.key AND e.t BETWEEN p.t - window AND p.t)

Spark plans the correlated form as a nested-loop join, and a range join
enumerates every (probe, event) pair of a key - quadratic for a busy key.
Here no pair is ever formed; the count is a difference of running sums in one
sort:

* An id counts for a probe when its first occurrence at or after ``lo`` is at
  most ``hi``. With the id's occurrences in time order and *short gaps* the
  steps between consecutive occurrences no longer than the window,
  ``distinct ids = occurrences in [lo, hi] - short gaps inside [lo, hi]``
  (every further occurrence of an id inside the window closes a gap that
  starts inside it; a long gap cannot fit inside the window).
* A short gap ``(a, b)`` lies inside ``[lo, hi]`` exactly when ``b <= hi``
  and not ``a < lo`` (``a < lo`` already implies ``b <= hi``), so with
  ``U = occurrences - gap ends`` and ``V = occurrences - gap starts``,
  ``count = U(<= hi) - V(< lo)``.
* Occurrences, gap starts and ends and the probes' ``lo`` / ``hi`` markers are
  put in order by (time, kind) within each key, with ``lo`` before and ``hi``
  after the events of equal time, and ``U``, ``V`` are running sums over that
  order.

Gaps come from ``LEAD`` over each (key, id). Both steps cut a key into days
(``operators.sequence``), so a busy key is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sequence import lead_within, running_sums


def lookback_distinct_count(
    probes: DataFrame,
    probe_id: str,
    probe_key: str,
    probe_time: str,
    events: DataFrame,
    event_id: str,
    event_key: str,
    event_time: str,
    window_days: int,
    name: str,
) -> DataFrame:
    """Return ``probes`` with an added column ``name`` (0 when nothing matches).

    ``probe_id`` must identify a probe row."""
    window = F.expr(f"interval {int(window_days)} days")
    ev = (
        events.select(
            F.col(event_key).alias("__key"), F.col(event_time).alias("__t"), F.col(event_id).alias("__id")
        )
        .filter(F.col("__key").isNotNull() & F.col("__t").isNotNull() & F.col("__id").isNotNull())
        .dropDuplicates(["__key", "__id", "__t"])
    )
    steps = lead_within(ev, ["__key", "__id"], ["__t"], F.unix_date(F.to_date("__t")), {"__t_next": "__t"})
    gaps = steps.filter(F.col("__t_next").isNotNull() & (F.col("__t_next") <= F.col("__t") + window))

    pr = probes.select(
        F.col(probe_id).alias("__probe"), F.col(probe_key).alias("__key"), F.col(probe_time).alias("__t")
    ).filter(F.col("__key").isNotNull() & F.col("__t").isNotNull())
    probe_type = pr.schema["__probe"].dataType

    def point(df: DataFrame, t: str, u: int, v: int) -> DataFrame:
        return df.select(
            "__key", F.col(t).alias("__t"), F.lit(1).alias("__kind"), F.lit(u).alias("__u"), F.lit(v).alias("__v"),
            F.lit(None).cast(probe_type).alias("__probe"),
        )

    def marker(t, kind: int) -> DataFrame:
        return pr.select(
            "__key", t.alias("__t"), F.lit(kind).alias("__kind"), F.lit(0).alias("__u"), F.lit(0).alias("__v"),
            "__probe",
        )

    stream = (
        point(ev, "__t", 1, 1)  # occurrences
        .unionByName(point(gaps, "__t", 0, -1))  # short-gap starts
        .unionByName(point(gaps, "__t_next", -1, 0))  # short-gap ends
        .unionByName(marker(F.col("__t") - window, 0))  # lo: before events of equal time
        .unionByName(marker(F.col("__t"), 2))  # hi: after events of equal time
    )
    sums = {"__sum_u": F.col("__u"), "__sum_v": F.col("__v")}
    dated = stream.withColumn("__day", F.to_date("__t"))
    summed = running_sums(dated, ["__key"], ["__t", "__kind"], "__day", sums)
    counts = (
        summed.filter(F.col("__kind") != 1)
        .groupBy("__probe")
        .agg(
            (
                F.sum(F.when(F.col("__kind") == 2, F.col("__sum_u")).otherwise(0))
                - F.sum(F.when(F.col("__kind") == 0, F.col("__sum_v")).otherwise(0))
            ).alias("__n")
        )
    )
    out = probes.join(counts, probes[probe_id] == counts["__probe"], "left")
    return out.select(*probes.columns, F.coalesce(F.col("__n"), F.lit(0)).cast("long").alias(name))
