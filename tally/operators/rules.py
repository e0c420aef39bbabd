"""Declarative data-quality rules, evaluated in a single pass.

An :class:`Expectation` names a rule and says which rows fail it.  Row rules are
plain ``Column`` predicates; ``unique`` and ``referential_integrity`` need the
whole table and are evaluated with one aggregate / one join each, so a table
with N rules is scanned once instead of N times.

Semantics kept from the reference:

* NULL passes ``positive``, ``non_negative`` and ``isin``; only ``not_null``
  catches it.  An ``unless`` that is NULL exempts nothing and fails nothing.
* ``unique`` fails every row of a duplicated, non-NULL value.
* ``referential_integrity`` fails rows whose key has no match; a NULL key fails.
* Quarantine is by row id: when any row with an id fails a critical rule, every
  row with that id is quarantined (NULL ids form one group).
* Warnings are counted, never quarantine.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITICAL = "critical"
WARNING = "warning"


@dataclass(frozen=True)
class Expectation:
    name: str
    kind: str  # row | unique | ref | frame
    predicate: Column | None = None  # failing rows: predicate is TRUE
    column: str | None = None
    ref: DataFrame | None = None
    ref_column: str | None = None
    frame_check: Callable[[DataFrame], DataFrame] | None = None
    severity: str = CRITICAL
    allow_null: bool = False  # ref rules: a NULL key passes (optional foreign key)

    def with_severity(self, severity: str) -> "Expectation":
        return replace(self, severity=severity)

    def renamed(self, name: str) -> "Expectation":
        return replace(self, name=name)


def row_rule(name: str, failing: Column, severity: str = CRITICAL) -> Expectation:
    """User-defined rule from a predicate that is TRUE on failing rows (NULL passes)."""
    return Expectation(name, "row", predicate=F.coalesce(failing, F.lit(False)), severity=severity)


def frame_rule(name: str, check: Callable[[DataFrame], DataFrame], severity: str = CRITICAL) -> Expectation:
    """User-defined rule as a function returning the failing rows (must keep ``_row_id``)."""
    return Expectation(name, "frame", frame_check=check, severity=severity)


def not_null(column: str) -> Expectation:
    return row_rule(f"not_null:{column}", F.col(column).isNull())


def positive(column: str) -> Expectation:
    return row_rule(f"positive:{column}", ~(F.col(column) > 0))


def non_negative(column: str, unless: Column | None = None) -> Expectation:
    failing = F.col(column) < 0
    if unless is not None:
        failing = failing & ~unless
    return row_rule(f"non_negative:{column}", failing)


def isin(column: str, allowed: Sequence[str]) -> Expectation:
    return row_rule(f"isin:{column}", ~F.col(column).isin(list(allowed)))


def between(column: str, low=None, high=None, strict_low: bool = False, condition: Column | None = None,
            name: str | None = None) -> Expectation:
    """Gate-style range rule; rows outside ``condition`` are not checked."""
    c = F.col(column)
    ok = F.lit(True)
    if low is not None:
        ok = ok & ((c > F.lit(low)) if strict_low else (c >= F.lit(low)))
    if high is not None:
        ok = ok & (c <= F.lit(high))
    failing = ~ok
    if condition is not None:
        failing = failing & condition
    return row_rule(name or f"between:{column}", failing)


def distinct_columns(left: str, right: str) -> Expectation:
    """Rows whose two columns hold the same value (a transfer to its own account); NULL passes."""
    return row_rule("distinct_accounts", F.col(left) == F.col(right))


def unique(column: str) -> Expectation:
    return Expectation(f"unique:{column}", "unique", column=column)


def referential_integrity(column: str, ref: DataFrame, ref_column: str, allow_null: bool = False) -> Expectation:
    """Rows whose key has no match in ``ref``.  A NULL key fails unless
    ``allow_null`` (for optional foreign keys)."""
    return Expectation(f"referential_integrity:{column}->{ref_column}", "ref", column=column, ref=ref,
                       ref_column=ref_column, allow_null=allow_null)


@dataclass
class Evaluation:
    """Result of one pass: ``flagged`` carries one boolean per rule."""

    flagged: DataFrame
    rules: list
    id_column: str
    flag_columns: list = field(default_factory=list)
    base_columns: list = field(default_factory=list)

    def counts(self, by: Sequence[str] = ()) -> DataFrame:
        """(*by, rule_name, severity, rows_checked, rows_failed, passed) — one aggregate."""
        aggs = [F.count(F.lit(1)).alias("_total")]
        aggs += [F.sum(F.col(f).cast("long")).alias(f) for f in self.flag_columns]
        one = self.flagged.groupBy(*by).agg(*aggs)
        rows = F.array(*[
            F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"),
                     F.col("_total").cast("long").alias("rows_checked"),
                     F.coalesce(F.col(f), F.lit(0)).cast("long").alias("rows_failed"))
            for r, f in zip(self.rules, self.flag_columns)
        ])
        return one.select(*by, F.inline(rows)).withColumn("passed", F.col("rows_failed") == 0)

    def layer_counts(self, order: Sequence[str], date: str = "business_date") -> DataFrame:
        """Per date the rows of the input (``bronze``), of :meth:`quarantined` and of :meth:`clean_latest`
        (``silver``), all three from one pass: counts per (id, date) first, then per id, whose
        dates are few."""
        rest = [c for c in self.base_columns if c != self.id_column and c not in order]
        newest = F.max(F.struct(*[F.col(c) for c in (*order, *rest)])).alias("newest")
        days = self.flagged.select(*self.base_columns, F.coalesce(self._row_failed(), F.lit(False)).alias("_failed")).groupBy(
            self.id_column, F.col(date).alias("_day")).agg(F.count(F.lit(1)).alias("n"), F.bool_or("_failed").alias("failed"), newest)
        ids = days.groupBy(self.id_column).agg(F.bool_or("failed").alias("failed"), F.max("newest").alias("newest"),
                                               F.collect_list(F.struct("_day", "n")).alias("days"))
        none = F.lit(0).cast("long")
        row = lambda day, bronze, silver, out: F.struct(
            day.alias(date), bronze.alias("bronze"), silver.cast("long").alias("silver"), out.alias("quarantine"))
        landed = F.transform("days", lambda d: row(d["_day"], d["n"], none, F.when(F.col("failed"), d["n"]).otherwise(none)))
        kept = F.array(row(F.col("newest")[date], none, F.when(F.col("failed"), 0).otherwise(1), none))
        parts = ids.select(F.inline(F.concat(landed, kept)))
        return parts.groupBy(date).agg(*[F.sum(c).cast("long").alias(c) for c in ("bronze", "silver", "quarantine")]).filter("bronze > 0")

    def failed_rules(self) -> Column:
        names = [F.when(F.col(f), F.lit(r.name)) for r, f in zip(self.rules, self.flag_columns)
                 if r.severity == CRITICAL]
        if not names:
            return F.array().cast("array<string>")
        return F.array_compact(F.array(*names))

    def _row_failed(self) -> Column:
        crit = [F.col(f) for r, f in zip(self.rules, self.flag_columns) if r.severity == CRITICAL]
        out = F.lit(False)
        for c in crit:
            out = out | c
        return out

    def failing_ids(self) -> DataFrame:
        """Distinct ids (NULL included) having at least one critically failing row."""
        return self.flagged.filter(self._row_failed()).select(F.col(self.id_column).alias("_qid")).distinct()

    def quarantined(self) -> DataFrame:
        """Every row whose id has a failing row, with the rules that row failed."""
        ids = self.failing_ids()
        hit = self.flagged.join(ids, self.flagged[self.id_column].eqNullSafe(ids["_qid"]), "left_semi")
        return hit.select(*self.base_columns, self.failed_rules().alias("failed_rules"))

    def clean(self) -> DataFrame:
        """Rows whose id never fails (all of them, duplicates kept)."""
        ids = self.failing_ids()
        keep = self.flagged.join(ids, self.flagged[self.id_column].eqNullSafe(ids["_qid"]), "left_anti")
        return keep.select(*self.base_columns)

    def clean_latest(self, order: Sequence[str]) -> DataFrame:
        """Newest row (by ``order``) of every id that never fails, in ONE grouped
        aggregate: the id's failure flag and its newest row are combined
        map-side, so a hot id costs no more than a cold one and no self-join is
        needed.  NULL ids form one group, as in the reference."""
        from tally.operators.dedup import latest_per_key

        return latest_per_key(self.flagged.select(*self.base_columns, self._row_failed().alias("_failed")),
                              [self.id_column], order, veto="_failed")


def evaluate(df: DataFrame, rules: Sequence[Expectation], id_column: str = "id") -> Evaluation:
    """Attach one boolean column per rule to ``df`` (TRUE = row fails the rule)."""
    base = list(df.columns)
    out = df
    flags = []
    needs_row_id = any(r.kind == "frame" for r in rules)
    if needs_row_id and "_row_id" not in base:
        out = out.withColumn("_row_id", F.col(id_column))
    for i, r in enumerate(rules):
        flag = f"_rule_{i}"
        if r.kind == "row":
            out = out.withColumn(flag, r.predicate)
        elif r.kind == "unique":
            key = f"_dupkey_{i}"
            # partial aggregation collapses a hot value map-side before the shuffle
            dups = (
                df.filter(F.col(r.column).isNotNull()).groupBy(r.column).agg(F.count(F.lit(1)).alias("_n"))
                .filter(F.col("_n") > 1).select(F.col(r.column).alias(key))
            )
            out = out.join(dups, out[r.column] == dups[key], "left").withColumn(flag, F.col(key).isNotNull()).drop(key)
        elif r.kind == "ref":
            key = f"_refkey_{i}"
            known = r.ref.select(F.col(r.ref_column).alias(key)).distinct()
            miss = F.col(key).isNull()
            if r.allow_null:
                miss = miss & F.col(r.column).isNotNull()
            out = out.join(known, out[r.column] == known[key], "left").withColumn(flag, miss).drop(key)
        elif r.kind == "frame":
            key, hit = f"_frkey_{i}", f"_frhit_{i}"
            failing = (r.frame_check(out.select(*base, "_row_id")).select(F.col("_row_id").alias(key)).distinct()
                       .withColumn(hit, F.lit(True)))
            out = (out.join(failing, out["_row_id"].eqNullSafe(failing[key]), "left")
                   .withColumn(flag, F.coalesce(F.col(hit), F.lit(False))).drop(key, hit))
        else:
            raise ValueError(f"unknown rule kind {r.kind}")
        flags.append(flag)
    return Evaluation(out, list(rules), id_column, flags, base)


def gate_counts(df: DataFrame, rules: Sequence[Expectation], prefix: str = "gx") -> DataFrame:
    """Post-condition gate: per-rule unexpected counts with gate-style names."""
    ev = evaluate(df, rules)
    return ev.counts().withColumn("rule_name", F.concat(F.lit(f"{prefix}:"), F.col("rule_name")))


class GateFailed(RuntimeError):
    pass


def assert_gate(counts_rows: list) -> None:
    failed = [f"{r['table_name']}.{r['rule_name']} ({r['rows_failed']} rows)" for r in counts_rows if not r["passed"]]
    if failed:
        raise GateFailed(f"gate failed on Silver output, Gold not built: {failed}")
