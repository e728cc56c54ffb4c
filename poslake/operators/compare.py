"""Reconcile two versions of the positions table field by field.

Align expected and actual on the key (full outer, null-safe; duplicate keys
paired by position), then emit one row per differing field through a single
``explode`` of an array of mismatch structs — one pass over the aligned rows,
no per-field joins.  Only the summary (and the bounded failure listing) is
ever collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_FIELD = "__row__"
MAX_FAILURE_LINES = 200
NUMERIC = (T.DecimalType, T.DoubleType, T.FloatType)


@dataclass
class CompareOptions:
    keys: list[str]
    one_step: bool = True
    two_steps: bool = False
    use_all_fields: bool = True
    phase1_fields: set[str] | None = None
    phase2_fields: set[str] | None = None
    excluded_fields: set[str] = field(default_factory=set)
    string_case_insensitive: bool = False
    numeric_tolerance: Decimal = Decimal("0.00001")
    tolerant_fields: set[str] | None = None  # None: every numeric field


def field_sets(opts: CompareOptions, columns: list[str]) -> dict[int, list[str]]:
    """Phase → fields.  One-step is on if asked or when using all fields;
    phase 2 exists only in two-step mode.  Names are case-sensitive."""
    non_key = [c for c in columns if c not in opts.keys]
    phases: dict[int, list[str]] = {}
    if opts.use_all_fields:
        phases[1] = [c for c in non_key if c not in opts.excluded_fields]
    else:
        phases[1] = [c for c in non_key if c in (opts.phase1_fields or set())]
    if opts.two_steps:
        phases[2] = [c for c in non_key if c in (opts.phase2_fields or set())]
    return phases


def positions_in_key(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """1-based position of each row among the rows sharing its key, in the
    order (fields ascending, NULLs first).

    Keys seen once get position 1 directly: a key-count aggregate finds the
    repeated keys, and semi/anti joins against that (usually small) set split
    the rows.  Only rows of repeated keys are positioned, skew-safely: a
    global sort on (key, fields) spreads a hot key over many range
    partitions; ``monotonically_increasing_id`` numbers rows within each
    partition; a per-(key, partition) aggregate plus a running sum over that
    small table gives each partition's offset, joined back on (key, partition)."""
    from ..session import cut
    src = df  # a table scan in practice: re-reading it is cheaper than copying it
    # Written once: whether any key repeats, and both joins, read it.
    repeated = cut(src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                   .where(F.col("_n") > 1).select(*keys))
    if repeated.isEmpty():
        return src.withColumn("_pos", F.lit(1).cast("bigint"))
    ren = repeated.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = c if on is None else on & c
    single = src.join(ren, on, "left_anti").withColumn("_pos", F.lit(1).cast("bigint"))
    multi = src.join(ren, on, "left_semi")
    order = [F.col(c).asc_nulls_first() for c in keys + fields]
    ided = cut(multi.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    ided = ided.withColumn("_pid", F.shiftrightunsigned("_id", 33))
    parts = (ided.groupBy(*keys, "_pid")
             .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    parts = parts.select(*[F.col(k).alias(f"_p_{k}") for k in keys],
                         F.col("_pid").alias("_p_pid"), "_first", "_before")
    cond = F.col("_pid") == F.col("_p_pid")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_p_{k}"))
    j = ided.join(parts, cond, "inner")
    pos = (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("bigint")
    return single.unionByName(j.select(*df.columns, pos.alias("_pos")))


def align(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Key-aligned pairs; ``status`` is both / expected_only / actual_only.

    Rows sharing a key are paired by position (all fields ascending, NULLs
    first), so duplicates are matched deterministically."""
    fields = [c for c in expected.columns if c not in keys]
    e = positions_in_key(expected, keys, fields)
    a = positions_in_key(actual.select(*expected.columns), keys, fields)
    e = e.select(*[F.col(c).alias(f"e_{c}") for c in e.columns], F.lit(True).alias("_e"))
    a = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns], F.lit(True).alias("_a"))
    cond = F.col("e__pos") == F.col("a__pos")
    for k in keys:
        cond = cond & F.col(f"e_{k}").eqNullSafe(F.col(f"a_{k}"))
    j = e.join(a, cond, "full_outer")
    status = (F.when(F.col("_e").isNull(), "actual_only")
              .when(F.col("_a").isNull(), "expected_only").otherwise("both"))
    return j.select(*[F.coalesce(F.col(f"e_{k}"), F.col(f"a_{k}")).alias(k) for k in keys],
                    F.coalesce(F.col("e__pos"), F.col("a__pos")).alias("pos"),
                    status.alias("status"),
                    *[F.col(f"e_{c}") for c in fields], *[F.col(f"a_{c}") for c in fields])


def _differs(c: str, dtype, opts: CompareOptions) -> Column:
    e, a = F.col(f"e_{c}"), F.col(f"a_{c}")
    tolerant = opts.tolerant_fields is None or c in opts.tolerant_fields
    if isinstance(dtype, NUMERIC) and tolerant:
        # Subtract in the field's own type: a wider cast would overflow large amounts.
        tol = F.lit(Decimal(str(opts.numeric_tolerance)) if isinstance(dtype, T.DecimalType)
                    else float(opts.numeric_tolerance))
        both_null = e.isNull() & a.isNull()
        one_null = e.isNull() != a.isNull()
        far = F.abs(e - a) > tol
        return ~both_null & (one_null | F.coalesce(far, F.lit(False)))
    if isinstance(dtype, T.StringType) and opts.string_case_insensitive:
        return ~F.lower(e).eqNullSafe(F.lower(a))
    return ~e.eqNullSafe(a)


def diff(expected: DataFrame, actual: DataFrame, opts: CompareOptions) -> DataFrame:
    """One row per (phase, key, field) that differs; rows present on
    one side only give one ``__row__`` difference per phase."""
    aligned = align(expected, actual, opts.keys)
    types = {f.name: f.dataType for f in expected.schema.fields}
    out = None
    for phase, fields in field_sets(opts, expected.columns).items():
        items = [F.when((F.col("status") == "both") & _differs(c, types[c], opts),
                        F.struct(F.lit(c).alias("field"),
                                 F.col(f"e_{c}").cast("string").alias("expected"),
                                 F.col(f"a_{c}").cast("string").alias("actual")))
                 for c in fields]
        items.append(F.when(F.col("status") != "both", F.struct(
            F.lit(ROW_FIELD).alias("field"),
            F.when(F.col("status") == "expected_only", "present").alias("expected"),
            F.when(F.col("status") == "actual_only", "present").alias("actual"))))
        d = (aligned.select(*opts.keys, "pos",
                            F.explode(F.array_compact(F.array(*items))).alias("d"))
             .select(F.lit(phase).alias("phase"), *opts.keys, "pos", "d.field", "d.expected",
                     "d.actual"))
        out = d if out is None else out.unionByName(d)
    return out


def summary(expected: DataFrame, actual: DataFrame, diffs: DataFrame,
            opts: CompareOptions) -> DataFrame:
    """Success, row counts and differences per phase (one row)."""
    phases = field_sets(opts, expected.columns)
    # One aggregate over the three inputs tagged by origin (no joins).
    u = (expected.select(F.lit("e").alias("_t"), F.lit(None).cast("int").alias("phase"))
         .unionByName(actual.select(F.lit("a").alias("_t"), F.lit(None).cast("int").alias("phase")))
         .unionByName(diffs.select(F.lit("d").alias("_t"), F.col("phase").cast("int"))))
    row = u.agg(F.count_if(F.col("_t") == "e").alias("expected_count"),
                F.count_if(F.col("_t") == "a").alias("actual_count"),
                *[F.count_if((F.col("_t") == "d") & (F.col("phase") == p)).alias(f"phase{p}_diffs")
                  for p in (1, 2)])
    p2 = F.col("phase2_diffs") if 2 in phases else F.lit(None).cast("bigint")
    return row.select(
        ((F.col("phase1_diffs") + F.coalesce(p2, F.lit(0))) == 0).alias("success"),
        F.col("expected_count").cast("bigint").alias("expected_count"),
        F.col("actual_count").cast("bigint").alias("actual_count"), F.col("phase1_diffs").cast("bigint").alias("phase1_diffs"),
        p2.cast("bigint").alias("phase2_diffs"))


def top_failures(diffs: DataFrame, keys: list[str], n: int = MAX_FAILURE_LINES) -> DataFrame:
    """The first ``n`` differences by key and field (a top-k report)."""
    return diffs.orderBy(*keys, "pos", "phase", "field").limit(n)
