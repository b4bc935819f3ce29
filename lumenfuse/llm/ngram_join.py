"""N-gram Jaccard join: documents whose sets of word 5-grams overlap by at least 80 %.

The sparse product of the document by n-gram incidence matrix with its transpose is never formed whole.

1. Rows that are equal as sets are one class (an aggregation by a 128-bit signature of the set); classes are the rows of
   the matrix.
2. Size-derived bounds thin the matrix: two sets of Jaccard t or more overlap in t * max(size), so they share an
   entry among the first ``size - ceil(t * size) + 1`` of each, in any order that all rows agree on.  The
   order puts n-grams that occur once first (they can match nothing and are not even emitted), then rare
   ones, then frequent ones by their count.
3. What is left are the columns of the thinned product.  In a first block each column is multiplied with
   one of its rows only, its pivot, the class of the smallest doc_id: work linear in the column.  Links are joined into
   components.  A column whose rows are then all in one component is done: copies of one text never make all pairs.
   Columns that are still open are multiplied with a second pivot, the row nearest to the first: of a group around a common
   text that row is the most central one.
4. In the last block the columns still open give those pairs whose components differ and which the bounds
   (sizes, positions, and the triangle inequality of the Jaccard distance to each pivot) allow.  A long column
   is dealt into parts of COLUMN_PART rows that meet part by part in tasks of their own.

The overlap of a pair that is left is accumulated from blocks of the full incidence: the sets of the classes in
question are written once, cut into ranges of hashes (a set of more than BLOCK_GRAMS n-grams has several), a pair meets
range by range, and the counts of the ranges are added up.

Edge cases: null, empty or blank text has an empty set and links with nothing; fewer than n words make one
n-gram of the whole; repeated rows are one class; rows with a null id are returned with a null component
and link with nothing; rows that share an id but not a text are one node of the graph: what links with any of them is in
its component; a long text is split piece by piece, and its distinct n-grams (8 bytes each) are what a task holds of it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfuse.llm import common as C
from lumenfuse.llm.keycount import KeyCounts, count_keys

SHINGLE, PERCENT, PIVOTS = 5, 80, 2
#: N-grams of a set in one range of hashes, about; rows of a column that meet in one task.
BLOCK_GRAMS, COLUMN_PART = 2048, 512


def _sets(batches: Iterator[pa.RecordBatch], n: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(rows, the sorted distinct n-gram hashes of each)."""
    for rows, words, lens in C.chunks_of_words(batches, text, lower=True):
        w = np.ascontiguousarray(words[:, 0])
        h, sets = C.window_hashes(w, n), []
        for a, k in zip(C.starts_of(lens).tolist(), lens.tolist()):
            if k >= n:
                sets.append(np.unique(h[a : a + k - n + 1]))
            else:
                sets.append(C.mix(C.window_hashes(w[a : a + k], k) + np.uint64(k)) if k else np.empty(0, np.uint64))
        yield rows, sets


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    if not len(s):
        return 0, 0
    return int(np.sum(s, dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(C.mix(s + np.uint64(0x51ED))).astype(np.int64))


def _need(size: int, percent: int) -> int:
    """Overlap that a set of this size has at least with any set that it links with."""
    return -(-size * percent // 100)


def _signed_rows(rows: DataFrame, n: int, percent: int, known) -> DataFrame:
    """doc_id, n, s1, s2 (signature of the set), prefix (hashes that may repeat elsewhere), at (their ranks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info: KeyCounts = known.value
        for b, sets in _sets(batches, n):
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
            rank = np.where(info.repeated(flat), info.frequency(flat) + 1, 0)
            s1, s2, prefix, at, a = [], [], [], [], 0
            for s, k in zip(sets, sizes.tolist()):
                r = rank[a : a + k]
                a += k
                for x, y in zip((s1, s2), _signature(s)):
                    x.append(y)
                keep = k - _need(k, percent) + 1 if k else 0
                once = int(np.count_nonzero(r == 0))
                if once >= keep:
                    prefix.append(None)
                    at.append(None)
                    continue
                some = np.flatnonzero(r)
                some = some[np.argsort(r[some], kind="stable")][: keep - once]  # by frequency, then by hash
                prefix.append(C.signed(s[some]))
                at.append(np.arange(once, once + len(some), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), pa.array(sizes), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))],
                names=["doc_id", "n", "s1", "s2", "prefix", "at"],
            )

    return rows.mapInArrow(C.lean(run), "doc_id long, n long, s1 long, s2 long, prefix array<long>, at array<int>")


def _level(size: str):
    """Level of cutting of a set: 2**level ranges of hashes."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.expr(f"{size} / {BLOCK_GRAMS}")))).cast("int")


def _blocks(ids: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(cls, level, part, grams): the sets of the classes ``ids(cls)`` in ranges of hashes, at each level that a partner may ask for; written."""
    wanted = C.materialize(ids.join(classes, "cls"))
    some = rows.join(C.checked_broadcast(C.materialize(wanted.select(F.col("rep").alias("doc_id")).distinct())), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, n):
            out: list[tuple] = []
            for s in sets:
                if not len(s):
                    continue
                low = max(0, int(np.ceil(np.log2(len(s) / BLOCK_GRAMS))))
                high = max(0, int(np.ceil(np.log2(len(s) * 100 / percent / BLOCK_GRAMS))))
                s1, s2 = _signature(s)
                for level in range(low, high + 1):
                    at = (s >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(len(s), np.int64)
                    cut = np.searchsorted(at, np.arange((1 << level) + 1))
                    out += [(s1, s2, len(s), level, p, C.signed(s[cut[p] : cut[p + 1]])) for p in range(1 << level) if cut[p] < cut[p + 1]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["s1", "s2", "n", "level", "part", "grams"])

    sets = some.select("text").mapInArrow(C.lean(run), "s1 long, s2 long, n long, level int, part int, grams array<long>")
    return C.materialize(sets.join(C.checked_broadcast(wanted.select("cls", "s1", "s2", "n")), ["s1", "s2", "n"]).select("cls", "level", "part", "grams").dropDuplicates(["cls", "level", "part"]))


def _overlaps(pairs: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, na, nb, both): exact overlap and sizes of each pair of classes (a, b, na, nb); written."""
    sets = _blocks(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), rows, classes, n, percent)
    asked = pairs.withColumn("level", F.greatest(_level("na"), _level("nb")))
    one = asked.join(sets.select(F.col("cls").alias("a"), "level", "part", F.col("grams").alias("x")), ["a", "level"])
    two = one.join(sets.select(F.col("cls").alias("b"), "level", "part", F.col("grams").alias("y")), ["b", "level", "part"])
    return C.materialize(two.select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("k")).groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("both")))


def jaccard_components(documents: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``documents(doc_id, text, ...)``: doc_id, n_shingles, component_id, n_copies.

    component_id is the smallest doc_id reachable by links of Jaccard ``percent`` or more; n_copies counts the
    rows with the very same set.  Other columns of the input are not read.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for _, sets in _sets(batches, n):
            yield [np.concatenate(sets) if sets else np.empty(0, np.uint64)]

    known = spark.sparkContext.broadcast(count_keys(rows.select("text"), hashes))
    signed = C.materialize(_signed_rows(rows, n, percent, known))
    known.destroy()
    # classes of equal sets; those with nothing to probe are alone
    members = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = members.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    classes = C.materialize(classes.withColumn("cls", F.monotonically_increasing_id()))
    probing = members.where(F.col("prefix").isNotNull()).join(classes.select("s1", "s2", "n", "rep", "cls"), ["s1", "s2", "n"]).where(F.col("doc_id") == F.col("rep"))
    probing = probing.dropDuplicates(["cls"])
    cells = C.materialize(probing.select("cls", "rep", F.col("n").alias("size"), F.explode(F.arrays_zip("prefix", "at")).alias("z")).select("cls", "rep", "size", F.col("z.prefix").alias("h"), F.col("z.at").alias("at")))
    first = cells.groupBy("h").agg(F.min(F.struct("rep", "cls", "size", "at")).alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1")
    columns = C.materialize(cells.join(first.select("h", F.struct("p.cls", "p.size", "p.at").alias("p")), "h").select("h", "cls", "size", "at", "p", F.lit(-1).cast("long").alias("component"), F.lit(-2).cast("long").alias("p_component")))

    def allowed(x: str, nx: str, ax: str, y: str, ny: str, ay: str):
        """Size-derived bounds of a pair that meets in a column."""
        least = F.ceil(F.expr(f"({nx} + {ny}) * {percent} / {100 + percent}.0D - 1e-9"))
        return (F.expr(f"100 * least({nx}, {ny}) >= {percent} * greatest({nx}, {ny}) and {x} <> {y}")) & (F.expr(f"least({nx} - {ax}, {ny} - {ay})") >= least)

    # an id on rows of several classes joins them
    twice = C.checked_broadcast(C.materialize(members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")))
    shared = C.materialize(members.join(twice, "doc_id", "left_semi").join(classes.select("s1", "s2", "n", "cls"), ["s1", "s2", "n"]).select("doc_id", "cls").distinct())
    links = shared.join(shared.groupBy("doc_id").agg(F.min("cls").alias("lo")), "doc_id").where("cls > lo").select(F.col("cls").alias("src"), F.col("lo").alias("dst"))
    hit = F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent
    linked = lambda m: m.where(hit).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    measured, away = [], []
    for i in range(PIVOTS):
        # every open column times its pivot
        pairs = columns.where(allowed("p.cls", "p.size", "p.at", "cls", "size", "at") & (F.col("component") != F.col("p_component")))
        pairs = pairs.select(F.least("p.cls", "cls").alias("a"), F.greatest("p.cls", "cls").alias("b"), F.when(F.col("p.cls") < F.col("cls"), F.col("p.size")).otherwise(F.col("size")).alias("na"), F.when(F.col("p.cls") < F.col("cls"), F.col("size")).otherwise(F.col("p.size")).alias("nb")).distinct()
        for m in measured:
            pairs = pairs.join(m.select("a", "b"), ["a", "b"], "left_anti")
        measured.append(_overlaps(C.materialize(pairs), rows, classes, n, percent))
        new = linked(measured[-1])
        if i == 0 or not new.isEmpty():
            comp = C.materialize(C.connected_components(links.union(new)))
            links = comp.select(F.col("node").alias("src"), F.col("component").alias("dst"))
        # columns whose rows are not in one component yet, and how far from the pivot each row is
        named = columns.drop("component", "p_component", "parts").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        open_ = named.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
        distance = functools.reduce(DataFrame.union, measured).select("a", "b", (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias(f"d{i}"))
        named = named.join(C.checked_broadcast(C.materialize(open_)), "h", "left_semi").withColumns({"a": F.least("p.cls", "cls"), "b": F.greatest("p.cls", "cls")}).join(distance, ["a", "b"], "left").drop("a", "b")
        away.append(f"d{i}")
        named = C.materialize(named.where("cls <> p.cls").drop("p"))
        near = named.groupBy("h").agg(F.min(F.struct(F.coalesce(away[-1], F.lit(2.0)).alias("d"), "cls", "size", "at", "component")).alias("p"), F.ceil(F.count(F.lit(1)) / COLUMN_PART).cast("int").alias("parts"))
        columns = named.join(near.select("h", F.struct("p.cls", "p.size", "p.at").alias("p"), F.col("p.component").alias("p_component"), "parts"), "h")
        columns = C.materialize(columns)
    # all that is left of the open columns, part by part
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    columns = columns.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    left, right = (columns.select("h", *([F.col("part").alias("px"), every.alias("py")] if s == "x" else [every.alias("px"), F.col("part").alias("py")]), *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "size", "at", "component", *away)]) for s in "xy")
    more = left.join(right, ["h", "px", "py"]).where((F.col("cls_x") < F.col("cls_y")) & (F.col("component_x") != F.col("component_y")) & allowed("cls_x", "size_x", "at_x", "cls_y", "size_y", "at_y"))
    for d in away:
        more = more.where(F.coalesce(F.abs(F.col(f"{d}_x") - F.col(f"{d}_y")) <= (100 - percent) / 100 + 1e-9, F.lit(True)))
    more = more.select(F.col("cls_x").alias("a"), F.col("cls_y").alias("b"), F.col("size_x").alias("na"), F.col("size_y").alias("nb")).distinct()
    for m in measured:
        more = more.join(m.select("a", "b"), ["a", "b"], "left_anti")
    more = C.materialize(more)
    if not more.isEmpty() and not (new := linked(_overlaps(more, rows, classes, n, percent))).isEmpty():
        comp = C.materialize(C.connected_components(links.union(new)))
    comp = comp.withColumnRenamed("node", "cls")
    small = classes.select("cls", "rep").join(comp, "cls").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = classes.join(comp, "cls", "left").join(small, "component", "left").select("s1", "s2", "n", "n_copies", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.select("doc_id", "n", "s1", "s2").join(of_class, ["s1", "s2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
