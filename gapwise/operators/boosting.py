"""A gradient-boosted regression baseline: histogram trees, one mergeable aggregate a level, applied as one Column."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.sources.store import Scratch

#: Bins of a feature, and digits to which gradients are summed, as decimals: such sums don't depend on the order of rows.
BINS, DIGITS = 32, 6


@dataclass(eq=False)
class Node:
    """A leaf, or a split: rows with feature <= edge go left; null features go right."""

    value: float = 0.0
    feature: str | None = None
    edge: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(F.col(f"`{self.feature}`") <= self.edge, self.left.column()).otherwise(self.right.column())


@dataclass
class Boosted:
    """A constant and trees; predict() is a native expression over the features' columns."""

    base: float
    trees: list[Node] = field(default_factory=list)

    def predict(self) -> Column:
        return sum((t.column() for t in self.trees), F.lit(self.base))


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Distinct approximate quantiles of each feature: bins - 1 numbers at most, whatever the table's size."""
    marks = [k / bins for k in range(1, bins)]
    row = df.agg(*(F.percentile_approx(F.col(f"`{f}`").cast("double"), marks, 10_000).alias(f"f{k}") for k, f in enumerate(features))).first()
    return {f: sorted(set(row[f"f{k}"] or [])) for k, f in enumerate(features)}


def _bin(feature: str, edges: list[float]) -> Column:
    """How many edges are below the value; nulls come after all."""
    v = F.col(f"`{feature}`").cast("double")
    return F.when(v.isNull(), len(edges)).otherwise(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < v)) if edges else F.lit(0))


def best_split(bins: dict[int, tuple[float, int]], edges: int, least_rows: int, shrink: float) -> tuple[float, int] | None:
    """(gain, k) for the split after bin k that lowers the squared error most; of equal ones the first. None without one."""
    g, n = sum(s for s, _ in bins.values()), sum(c for _, c in bins.values())
    best, left_g, left_n = None, 0.0, 0
    for k in range(edges):
        s, c = bins.get(k, (0.0, 0))
        left_g, left_n = left_g + s, left_n + c
        if min(left_n, n - left_n) < least_rows:
            continue
        gain = left_g**2 / (left_n + shrink) + (g - left_g) ** 2 / (n - left_n + shrink) - g**2 / (n + shrink)
        if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-12)):
            best = gain, k
    return best


def fit_boosted(df: DataFrame, features: list[str], target: str, trees: int = 10, depth: int = 3, rate: float = 0.3, least_rows: int = 20, shrink: float = 1.0) -> Boosted:
    """Trees grown on the residuals of those before, level by level.

    A level is one aggregate of the whole table: (node, feature, bin) with the sum of residuals and the rows, reduced
    before it is shuffled; at most 2**level * features * BINS such rows come to the driver, whatever the table's size,
    and decide all splits of the level. A tree's predictions are added up in a stored table, so plans stay short.

    Rows with a null or non-finite target are left out; null features go right. Ties go to the feature that is listed
    first, then to the lower edge. Empty table: a model that predicts 0. Repeated rows count as often as they occur.
    """
    scratch = Scratch(df.sparkSession, "boosted")
    y = F.col(f"`{target}`").cast("double")
    known = df.filter(y.isNotNull() & (F.abs(y) < math.inf))
    edges = bin_edges(known, features)
    first = known.agg(F.avg(y)).first()[0]
    model = Boosted(first or 0.0)
    if first is None:
        return model
    binned = [_bin(f, edges[f]).cast("int").alias(f"b{k}") for k, f in enumerate(features)]
    rows = scratch.save(known.select(*binned, (y - F.lit(model.base)).alias("rest")), "rest-0")

    def where(node: Node) -> Column:
        """The number of the row's leaf, counted as in a full tree; -1 where it's done."""

        def down(node: Node, number: int) -> Column:
            if node.feature is None:
                return F.lit(-1 if node in done else number)
            return F.when(F.col(f"b{features.index(node.feature)}") <= edges[node.feature].index(node.edge), down(node.left, 2 * number)).otherwise(down(node.right, 2 * number + 1))

        return down(node, 1)

    def grown(node: Node) -> Column:
        if node.feature is None:
            return F.lit(node.value)
        return F.when(F.col(f"b{features.index(node.feature)}") <= edges[node.feature].index(node.edge), grown(node.left)).otherwise(grown(node.right))

    for turn in range(trees):
        root = Node()
        done: list[Node] = []
        leaves = {1: root}
        for level in range(depth + 1):
            cells = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f"b{k}").alias("bin")) for k in range(len(features))))).alias("cell")
            exact = F.sum(F.round("rest", DIGITS).cast(f"decimal(28,{DIGITS})"))
            found = rows.select(where(root).alias("leaf"), "rest", cells).filter("leaf > 0").groupBy("leaf", "cell.f", "cell.bin").agg(exact.alias("g"), F.count(F.lit(1)).alias("n")).collect()
            table: dict[int, dict[int, dict[int, tuple[float, int]]]] = {}
            for r in found:
                table.setdefault(r.leaf, {}).setdefault(r.f, {})[r.bin] = (float(r.g), r.n)
            after = {}
            for number, node in leaves.items():
                by_feature = table.get(number, {})
                some = next(iter(by_feature.values()), {})
                g, n = sum(s for s, _ in some.values()), sum(c for _, c in some.values())
                node.value = rate * g / (n + shrink) if n else 0.0
                splits = [(s[0], -f, s[1]) for f, b in by_feature.items() if level < depth and (s := best_split(b, len(edges[features[f]]), least_rows, shrink))]
                if not splits:
                    done.append(node)
                    continue
                _, f, k = max(splits, key=lambda s: (s[0], s[1]))
                node.feature, node.edge = features[-f], edges[features[-f]][k]
                node.left, node.right = Node(), Node()
                after |= {2 * number: node.left, 2 * number + 1: node.right}
            leaves = after
            if not leaves:
                break
        model.trees.append(root)
        rows = scratch.save(rows.withColumn("rest", F.col("rest") - grown(root)), f"rest-{turn + 1}")
        scratch.drop(f"rest-{turn}")
    scratch.close()
    return model
