"""Cleaning with a quarantine: every rule that a row breaks is named, and no row is lost."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gapwise.sources.store import Scratch, fresh


def broken_rules(rules: dict[str, Column]) -> Column:
    """The names, in order, of the rules that don't hold; a rule that is null doesn't."""
    marks = F.array(*(F.when(~F.coalesce(good, F.lit(False)), name) for name, good in rules.items()))
    return F.filter(marks, lambda m: m.isNotNull())


def quarantined(df: DataFrame, rules: dict[str, Column], into: str = "broken") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(accepted, rejected, counts): the rows that break no rule, those that do with the array `into` of the rules'
    names, and how many rows there are, are accepted and break each rule.

    One job evaluates all rules of a row, counts on the way and stores both parts, a folder each, in the shared folder.
    Columns may have any name. Empty table: both empty, counts of 0.
    """
    scratch = Scratch(df.sparkSession, "quarantine")
    (into, accepted) = fresh(df, into, "accepted")
    marked = df.withColumn(into, broken_rules(rules)).withColumn(accepted, F.size(into) == 0)
    names = list(rules)
    counts = Observation(f"quarantine-{uuid.uuid4().hex}")
    marked = marked.observe(
        counts, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col(accepted).cast("long")), F.lit(0)).alias("accepted"),
        *(F.coalesce(F.sum(F.array_contains(into, n).cast("long")), F.lit(0)).alias(f"rule_{k}") for k, n in enumerate(names)),
    )
    marked.write.mode("overwrite").partitionBy(accepted).parquet(scratch.path("rows"))
    stored = df.sparkSession.read.schema(marked.schema).parquet(scratch.path("rows"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    found = counts.get
    tally = {"rows": found["rows"], "accepted": found["accepted"]} | {n: found[f"rule_{k}"] for k, n in enumerate(names)}
    return stored.filter(F.col(accepted)).select(*columns), stored.filter(~F.col(accepted)).select(*columns, into), tally
