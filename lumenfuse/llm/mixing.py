"""Mixing sources to target weights by weighted fair queueing.

Each source sends its documents in a shuffled order (by a hash of the id, so reruns agree), as often as its
target needs.  A document's virtual finish time is its source's running token count divided by the target;
the mix takes documents by finish time until the total budget is spent, so at every moment all sources
have received tokens in proportion to their weights.

Nothing is ordered in one task: a source's running count is summed in two levels (hash buckets, then inside a bucket),
and so is the global order (ranges of finish time, then inside a range); only the sums of the buckets,
whose number is fixed, meet in one place.  A source of a third of all rows is spread over its buckets.  The range that the
budget cuts is parted again into ranges until at most EDGE_ROWS rows are left to be sorted.

Edge cases: null or blank text has size 0 and is taken 0 words; a null source is a source of its own,
last; a null id sorts first (such rows are shuffled by their texts' hash); repeated rows each count; ties go by the texts' hash; a text
of any length is one number here; an empty table gives no rows; sources without words get target 0.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfuse.llm.common import WHITE, materialize

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Buckets of a source's order (three hex digits of the hash), ranges of finish time per unit, and latest range.
BUCKET_DIGITS, RANGES, LAST, EDGE_ROWS = 3, 2048, 4, 100_000


def word_count(text) -> F.Column:
    """Number of runs of anything but ASCII white space."""
    t = F.btrim(text, F.lit(WHITE))
    return F.when(text.isNull() | (t == ""), 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> dict[str | None, float]:
    """Target of each source: ``share`` of all words by weight, at most ``most`` times its own; the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: float(most * n) for s, n in order}
    left, free, out = share * sum(n for _, n in order), [s for s, _ in order], {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= cap[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = cap[s]
        left -= sum(cap[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def _plan(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``mix`` for rows (row, doc_id, source, text) with a number of their own."""
    spark, tie = rows.sparkSession, F.xxhash64("text")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), tie.cast("string")))
    docs = rows.select("row", "doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("order"), tie.alias("tie"))
    docs = materialize(docs.withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS)))
    # one row per source and bucket; 4096 buckets a source
    sums = materialize(docs.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    by_source = [(r["source"], r["words"]) for r in sums.groupBy("source").agg(F.sum("words").alias("words")).collect()]
    goal = targets(by_source, weights, share, most)
    known = spark.createDataFrame([(s, n, float(goal[s])) for s, n in by_source], "source string, source_size long, target double")
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("source", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("before"))
    inside = W.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
    ran = docs.withColumn("ran", F.sum("size").over(inside)).alias("d")
    same = lambda x: F.col("d.source").eqNullSafe(F.col(f"{x}.source"))
    placed = ran.join(before.alias("b"), same("b") & (F.col("d.bucket") == F.col("b.bucket"))).join(F.broadcast(known).alias("k"), same("k"))
    placed = materialize(placed.select("d.row", "d.doc_id", "d.source", "d.order", "d.tie", "d.size", "k.source_size", "k.target", (F.col("d.ran") + F.col("b.before")).alias("ran")))
    # every copy with its finish time; words of no document are not queued
    copies = F.array(*[F.struct(F.lit(e).alias("epoch"), ((F.col("ran") + e * F.col("source_size")) / F.col("target")).alias("finish")) for e in range(most)])
    queue = placed.where("size > 0 and target > 0").select("row", "source", "order", "doc_id", "size", "tie", F.explode(copies).alias("c")).select("row", "source", "order", "doc_id", "size", "tie", "c.epoch", "c.finish")
    budget, taken, spent, low, width = float(sum(goal.values())), [], 0, 0.0, 1.0 / RANGES
    edge, last = queue, RANGES * LAST
    while True:
        # at most ``last`` + 1 rows are collected
        part = F.least(F.floor((F.col("finish") - low) / width), F.lit(last)).cast("long")
        sums_of = sorted((r["part"], r["words"], r["n"]) for r in edge.groupBy(part.alias("part")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect())
        cut = None
        for p, words, n in sums_of:
            if spent + words > budget:
                cut = p
                break
            spent += words
        taken.append((edge if cut is None else edge.where(part < cut)).select("row", "epoch"))
        if cut is None:
            break
        edge = edge.where(part == cut)
        if n <= EDGE_ROWS or cut == last or width < 1e-12:
            w = W.partitionBy(F.lit(0)).orderBy("finish", F.col("source").asc_nulls_last(), "order", "doc_id", "epoch", "tie").rowsBetween(W.unboundedPreceding, 0)
            taken.append(edge.withColumn("end", F.sum("size").over(w) + F.lit(spent)).where(F.col("end") <= budget).select("row", "epoch"))
            break
        low, width, last = low + cut * width, width / RANGES, RANGES - 1
    often = functools.reduce(DataFrame.union, taken).groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    out = placed.join(often, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)).cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "row")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of documents: doc_id, source, size, source_size, target, copies (how often taken), taken (words)."""
    return _plan(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text"), weights, share, most)


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: documents as often as taken, with the columns of ``documents``, whatever their names."""
    rows = materialize(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")))
    often = materialize(_plan(rows.select("row", "doc.doc_id", "doc.source", "doc.text"), weights, share, most).where("copies > 0").select("row", "copies"))
    # grows with the documents: the same join at every size
    return rows.join(often.hint("merge"), "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
