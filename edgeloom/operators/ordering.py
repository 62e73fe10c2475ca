"""Operators that depend on order: numbering, first and last per key, running cut-offs, nearest marks, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.operators.shared import cut


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in range partitions, each sorted, with the number of its partition (_part) and its place there from 0 (_row).

    They are written to the checkpoint folder with the rows, as a second run of a range shuffle would deal rows anew.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftrightunsigned("_at", 33).cast("int")).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return cut(rows.drop("_at"))


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with its place (from 1) in the total order of `order`, without one task that holds all rows.

    Rows are range-partitioned and sorted; a row's place is its place within its partition plus the rows of the
    partitions before, of which there is one count each. Rows that tie take places in any order.
    """
    rows = _ranged(df, order)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_row") + 1).cast("bigint")).drop("_part", "_row", "_before")  # a row a partition


def sequential_ids(df: DataFrame, order: list[str], prefix: str, name: str = "id", digits: int = 3) -> DataFrame:
    """E001, E002, ... in the order given; ids are made at the sink only."""
    return numbered(df, order, "_n").withColumn(name, F.concat(F.lit(prefix), F.when(F.length(F.col("_n").cast("string")) < digits, F.lpad(F.col("_n").cast("string"), digits, "0")).otherwise(F.col("_n").cast("string")))).drop("_n")


def last_per_key(df: DataFrame, keys: list[Column | str], seq: str = "seq") -> DataFrame:
    """Of each key the row with the greatest seq, aggregated before it is shuffled."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select(F.struct(*df.columns).alias("_r"), F.col(seq).alias("_s"), *(F.expr(k).alias(n) if isinstance(k, str) else k.alias(n) for k, n in zip(keys, names, strict=True)))
    return keyed.groupBy(*names).agg(F.max_by("_r", "_s").alias("_r")).select("_r.*")


def key_owners(names: DataFrame) -> DataFrame:
    """names(key, rel, rank, walk_no) -> key, owner: the page with the best rank owns a key, then the one walked first."""
    return names.groupBy("key").agg(F.min_by("rel", F.struct("rank", "walk_no")).alias("owner"))


def key_collisions(names: DataFrame) -> DataFrame:
    """key, owner, n: keys that more than one page claims."""
    owned = names.groupBy("key").agg(F.min_by("rel", F.struct("rank", "walk_no")).alias("owner"), F.count_distinct("rel").alias("n"))
    return owned.where("n > 1")


def slug_paths(nodes: DataFrame) -> DataFrame:
    """nodes(seq, name, kind, slug, kind_slug) -> with `path_slug`: base, base--kind, base--kind-2, ... in order of seq.

    Only nodes that share a slug meet in one group; the first has the bare slug.
    """
    first = W.partitionBy("slug").orderBy("seq")
    again = W.partitionBy("slug", "kind_slug").orderBy("seq")
    n = nodes.withColumn("_n", F.row_number().over(first))
    n = n.withColumn("_m", F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)).over(again))
    own = F.concat(F.col("slug"), F.lit("--"), F.col("kind_slug"))
    return n.withColumn("path_slug", F.when(F.col("_n") == 1, F.col("slug")).when(F.col("_m") == 1, own).otherwise(F.concat(own, F.lit("-"), F.col("_m").cast("string")))).drop("_n", "_m")


def within_budget(items: DataFrame, order: list[str], budget: int, cost: int) -> DataFrame:
    """items with `deferred`: whether their place exceeds budget // cost. Nothing is dropped; a cost of 0 fits all."""
    fits = budget // cost if cost > 0 else None
    placed = numbered(items, order, "place")
    return placed.withColumn("deferred", F.lit(False) if fits is None else F.col("place") > fits)


def running_budget(items: DataFrame, group: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """items with the running cost within their group and whether it exceeds the budget.

    A group may hold most rows: it is cut into ranges of its order, each range summed by itself and raised by the
    sums of the ranges before.
    """
    rows = _ranged(items, [*group, *order])
    sums = rows.groupBy("_part", *group).agg(F.sum(cost).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")  # a row a range
    own = rows.withColumn("_own", F.sum(cost).over(W.partitionBy("_part", *group).orderBy("_row").rowsBetween(W.unboundedPreceding, 0)))
    same = [F.col("_part") == F.col("_p"), *(F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group))]
    renamed = before.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_before")
    found = own.join(renamed, same).withColumn("running", (F.col("_own") + F.col("_before")))
    return found.select(*items.columns, "running", (F.col("running") > budget).alias("deferred"))


def nearest_before(lines: DataFrame, group: list[str], order: str, mark: Column, value: Column, name: str = "nearest") -> DataFrame:
    """lines with the value of the nearest line, up to and with their own, where `mark` holds."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(F.when(mark, value), ignorenulls=True).over(w))


def sliding_join(lines: DataFrame, group: list[str], order: str, text: str, width: int = 3, name: str = "joined") -> DataFrame:
    """lines with their text and that of the next width - 1, joined by spaces; fewer at the end."""
    w = W.partitionBy(*group).orderBy(order)
    return lines.withColumn(name, F.concat_ws(" ", F.col(text), *(F.lead(text, k).over(w) for k in range(1, width))))


def round_robin(df: DataFrame, stratum: str, order: list[str], limit: int) -> DataFrame:
    """`limit` rows that take turns over the strata: every stratum's first, then every second, ..."""
    w = W.partitionBy(stratum).orderBy(*order)
    turn = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)
    return turn.orderBy("turn", stratum).limit(limit)


def last_non_null(df: DataFrame, keys: list[str], seq: str, columns: list[str], first: list[str] = ()) -> DataFrame:
    """Upsert by key: of each column the last value that is not null; of `first` columns the first."""
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in first]
    return df.groupBy(*keys).agg(*aggs)
