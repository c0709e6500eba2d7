"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a keyed hash; epoch after epoch they
queue up, and a document's virtual finish time is the source's words up to
and including it, divided by the source's target.  The mix is the global order
by finish time, cut where the budget is full.

The words up to a document are summed in two steps (within hash buckets, then
over bucket totals), so no source, however large, is ever one task.  The cut
is found by counting words in equal slices of finish time and slicing the one
that holds the cut again; only counts of ``SLICES`` slices and at most
``EXACT`` last rows reach the driver.  Sums by source do too: the number of
sources is a property of the configuration, not of the documents.

Edge cases: null texts and empty texts have size 0 and are never taken; a null
source is a source of its own, last in order; repeated rows each count.  With
no words at all every target is 0.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_id, free_name, stored, table, with_own_ids, words

WEIGHTS = (5, 2, 1)
#: No document is taken more often.
EPOCHS = 3
SEED = "mix-1"
BUCKETS = 1024
SLICES = 4096
EXACT = 50_000
#: Sources are a property of the configuration; more are refused, as their sums go to the driver and to all tasks.
MOST_SOURCES = 100_000


def source_key(col: str = "source") -> Column:
    """Sorts by code point, null last."""
    return F.when(F.col(col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(col).cast("string")))


def targets(sizes: dict[str, int], weights: dict[str, float], epochs: int = EPOCHS) -> dict[str, float]:
    """Shares of the sum of ``sizes`` by weight; none above ``epochs`` times its source's size.

    What a capped source leaves goes to the others by weight, until none is above.
    """
    order = sorted(sizes, key=lambda k: (epochs * sizes[k] / weights[k], k))
    left, weight, out = sum(sizes.values()), sum(weights.values()), {}
    for k in order:
        share = left / weight
        if epochs * sizes[k] > share * weights[k]:
            break
        out[k] = float(epochs * sizes[k])
        left -= epochs * sizes[k]
        weight -= weights[k]
    return {k: out[k] if k in out else left * weights[k] / weight for k in sizes}


def finish_times(rows: DataFrame, aim: dict[str, float], total: dict[str, int]) -> DataFrame:
    """``rows`` (id, key, size) with ``base``: the source's words up to and including the row, in hash order."""
    spark = rows.sparkSession
    hashed = rows.where("size > 0").withColumn("h", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(SEED))))
    hashed = hashed.withColumn("b", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * BUCKETS / 2**32).cast("int"))
    inside = hashed.withColumn("base", F.sum("size").over(W.partitionBy("key", "b").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)))
    before = hashed.groupBy("key", "b").agg(F.sum("size").alias("n")).select(
        "key", "b", (F.sum("n").over(W.partitionBy("key").orderBy("b")) - F.col("n")).alias("before"))
    per = spark.createDataFrame([(k, float(aim[k]), int(total[k])) for k in aim], "key string, target double, source_size long")
    return (inside.join(before, ["key", "b"]).join(F.broadcast(per), "key")  # as many rows as sources
            .select("doc_id", "key", "size", "target", "source_size", (F.col("base") + F.col("before")).alias("base")))


def finish(epoch: Column | int) -> Column:
    return (F.lit(epoch) * F.col("source_size") + F.col("base")) / F.col("target")


def cut(queue: DataFrame, budget: int, epochs: int = EPOCHS) -> tuple[float, int, int]:
    """(finish time, id, epoch) of the last one in the order within the budget; an id of -1: none at that time."""
    each = queue.where("target > 0").select("doc_id", "size", F.explode(F.array(*[F.struct(finish(e).alias("v"), F.lit(e).alias("e")) for e in range(epochs)])).alias("x"))
    each = each.select("doc_id", "size", "x.v", "x.e")
    low, high, used = 0.0, 2.0, 0
    while True:
        if high == float("inf"):
            low, high = 2.0, 2.0 * (each.agg(F.max("v")).first()[0] or 1.0)
        step = (high - low) / SLICES
        part = each.where((F.col("v") >= low) & (F.col("v") < high)).groupBy(F.floor((F.col("v") - low) / step).alias("s")).agg(F.sum("size").alias("n"), F.count("*").alias("k"))
        slices = sorted(part.collect(), key=lambda r: r.s)
        for r in slices:
            if used + r.n > budget:
                break
            used += r.n
        else:
            if high == 2.0 and low == 0.0:
                low, high = 2.0, float("inf")
                continue
            return high, 2**63 - 1, epochs
        at, n = low + r.s * step, r.k
        if n <= EXACT or step < 1e-15:
            break
        low, high = at - step * 1e-9, at + step * (1 + 1e-9)
        used = each.where(F.col("v") < low).agg(F.sum("size")).first()[0] or 0
    inside = each.where((F.col("v") >= low) & (F.col("v") < high) & (F.floor((F.col("v") - low) / step) == int(r.s)))
    last = (at, -1, -1)
    for x in sorted((y.v, y.doc_id if y.doc_id is not None else -1, y.e, y.size) for y in inside.select("v", "doc_id", "e", "size").collect()):
        used += x[3]
        if used > budget:
            break
        last = x[:3]
    return last


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source key, size, source_size, target and taken words of each row of ``docs``.

    ``docs`` has doc_id, source and size; sources weigh ``weights``, repeating,
    in the order of ``source_key``.
    """
    rows = stored(docs.select("doc_id", source_key().alias("key"), F.col("size").cast("long").alias("size")), "mix")
    sums = rows.groupBy("key").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r.key: r.n for r in sums}
    weigh = {k: weights[i % len(weights)] for i, k in enumerate(sorted(sizes, key=lambda k: k.encode()))}
    aim = targets(sizes, weigh, epochs) if sum(sizes.values()) else {k: 0.0 for k in sizes}
    queue = finish_times(rows, aim, sizes)
    v, doc, epoch = cut(queue, sum(sizes.values()), epochs) if sum(sizes.values()) else (0.0, -1, -1)
    taken = F.lit(0)
    for e in range(epochs):
        t = finish(e)
        key = F.coalesce(F.col("doc_id"), F.lit(-1))
        within = (t < v) | ((t == v) & ((key < doc) | ((key == doc) & (F.lit(e) <= epoch))))
        taken = taken + F.when((F.col("target") > 0) & within, F.col("size")).otherwise(0)
    some = queue.select("doc_id", "key", "size", "source_size", "target", taken.cast("long").alias("taken"), *[finish(e).alias(f"finish_{e}") for e in range(epochs)])
    per = docs.sparkSession.createDataFrame([(k, float(aim[k]), int(sizes[k])) for k in aim], "key string, target double, source_size long")
    none = rows.where("size = 0").join(F.broadcast(per), "key").select("doc_id", "key", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), *[F.lit(None).cast("double").alias(f"finish_{e}") for e in range(epochs)])
    return some.unionByName(none)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def mixed_rows(docs: DataFrame, in_order: bool = False) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; ``in_order`` sorts them by ranges of finish time, the mix's own order.

    Rows with the same doc_id are taken alike; rows with a null doc_id each by themselves, equal ones alike.
    """
    return with_own_ids(docs, lambda rows: mixed_by_id(rows, in_order))


def mixed_by_id(docs: DataFrame, in_order: bool = False, epochs: int = EPOCHS) -> DataFrame:
    name = free_name(docs, "times")
    n = (F.col("taken") / F.col("size")).cast("int")
    own = F.slice(F.array(*[F.col(f"finish_{e}") for e in range(epochs)]), F.lit(1), n)
    taken = mix(sized(docs), epochs=epochs).where("taken > 0").groupBy("doc_id")
    copies = taken.agg((F.max_by(own, n) if in_order else F.max(n)).alias(name))
    rows = by_id(docs, copies, "inner").withColumn(name, F.explode(F.col(name) if in_order else F.sequence(F.lit(1), F.col(name))))
    if in_order:
        rows = rows.orderBy(name, "doc_id")
    return rows.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT key, sum(size)::BIGINT AS n, [{', '.join(map(str, WEIGHTS))}][1 + ((row_number() OVER (ORDER BY encode(key))) - 1) % {len(WEIGHTS)}]::BIGINT AS w FROM d GROUP BY key),
srt AS (SELECT *, {EPOCHS}.0::DOUBLE * n / w AS cap, row_number() OVER (ORDER BY {EPOCHS}.0::DOUBLE * n / w, key) AS k FROM src),
lft AS (SELECT *, ((SELECT sum(n) FROM src) - coalesce(sum({EPOCHS} * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS l,
    ((SELECT sum(w) FROM src) - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS u FROM srt),
fst AS (SELECT arg_min(l, k) AS l, arg_min(u, k) AS u, min(k) AS k FROM lft WHERE {EPOCHS} * n > l::DOUBLE / u * w),
aim AS (SELECT key, n, CASE WHEN fst.k IS NULL OR lft.k < fst.k THEN {EPOCHS}.0::DOUBLE * n ELSE (fst.l * w)::DOUBLE / fst.u END AS target FROM lft, fst),
que AS (SELECT doc_id, d.key, size, n, target, sum(size) OVER (PARTITION BY d.key ORDER BY md5(doc_id::VARCHAR || ':{SEED}'), doc_id, size ROWS UNBOUNDED PRECEDING) AS base
    FROM d JOIN aim USING (key) WHERE size > 0),
cpy AS (SELECT doc_id, size, e, (e * n + base)::DOUBLE / target AS v FROM que, range({EPOCHS}) AS r(e)),
run AS (SELECT doc_id, size, sum(size) OVER (ORDER BY v, doc_id, e ROWS UNBOUNDED PRECEDING) AS upto FROM cpy),
got AS (SELECT doc_id, sum(size) AS taken FROM run WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT d.doc_id, d.size, n AS source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM d JOIN aim USING (key) LEFT JOIN got USING (doc_id)
"""
