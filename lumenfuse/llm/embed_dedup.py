"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random lines.  Two vectors collide on a line if their projections are within
HALF of each other (a window centred on the query).  Pairs that collide on enough lines are verified by their exact
cosine.  The count asked for is calibrated: the difference of two unit vectors of cosine c projects to a
normal variable of deviation sqrt(2 - 2c), so a pair just at the threshold collides on a line with a known
probability p, and the binomial tail gives the largest count that such a pair reaches with a wanted probability.

Only vectors of one cell are compared: a cell is an interval of WIDTH, randomly shifted, on each of some further lines, the
anchors.  Their number grows with the logarithm of the largest label, without an end, so that a cell holds about CELL
vectors whatever the label; up to CELL a label is one cell.  A pair at the threshold falls into different cells with a known
probability, so several sets of anchors are used, as many as make the probability to miss it in all of them at most
half of 1 - RECALL; the count is calibrated to the other half.  Sets and count together find such a pair with probability
RECALL for labels of any size.  A pair that shares a cell of an earlier set is left to that set.

A cell of more than PART vectors is dealt into parts, and each task compares two parts (or one with itself): what it
holds is bounded whatever the cell, a hot label or cluster is spread over many tasks, and links are summed over them.

Equal vectors are one point with a multiplicity, so copies make no pairs.  A task returns sums of links
and edges that join its components, at most a few per vector, never all pairs of a group.

Edge cases: a null label, or a vector that is null, zero or holds null or non-finite components, links with
nothing (n_links 0, component its own id); vectors of different length do not link; repeated rows are links
of each other; a row with a null id links with nothing (n_links 0, null component and kept), even beside equal vectors; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfuse.llm.common import checked_broadcast, connected_components, materialize, mix
from lumenfuse.llm.vectors import matrix, valid_vectors

COSINE, LINES, HALF, WIDTH, CELL, PART, RECALL, SEED = 0.98, 24, 0.5, 2.0, 6000, 1000, 0.9999, 99
#: Lines on which all pairs are counted before those that cannot reach the count are dropped.
FIRST_LINES = 12


def collision(cosine: float, half: float = HALF) -> float:
    """Probability that a pair of this cosine collides on a line."""
    return math.erf(half / math.sqrt(2 - 2 * cosine) / math.sqrt(2)) if cosine < 1 else 1.0


def same_interval(deviation: float, width: float = WIDTH) -> float:
    """Probability that two numbers, a normal variable of this deviation apart, share an interval of a randomly shifted grid."""
    if not deviation:
        return 1.0
    r = width / deviation
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def needed_collisions(cosine: float, lines: int = LINES, half: float = HALF, recall: float = RECALL) -> int:
    p = collision(cosine, half)
    tail, need = 0.0, lines
    for c in range(lines, -1, -1):
        tail += math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
        if tail >= recall:
            return c
        need = c
    return need


def plan(largest: int, cosine: float, lines: int = LINES, half: float = HALF, recall: float = RECALL) -> tuple[int, int, int]:
    """(anchors of a set, sets, collisions asked for) for labels of up to ``largest`` vectors."""
    share = same_interval(math.sqrt(2))  # of a label's vectors in the cell of one of them, by one anchor
    anchors = max(0, math.ceil(math.log(max(1, largest / CELL)) / -math.log(share)))
    miss = 1 - same_interval(math.sqrt(2 - 2 * cosine)) ** anchors
    sets = max(1, math.ceil(math.log((1 - recall) / 2) / math.log(miss))) if miss > 0 else 1
    return anchors, sets, needed_collisions(cosine, lines, half, recall + miss**sets)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, lines: int = LINES, half: float = HALF, seed: int = SEED) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    rows = valid_vectors(embeddings, F.col("label").cast("string").alias("label")).where(F.col("label").isNotNull()).withColumn("dim", F.size("v"))
    points = materialize(rows.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("point"), F.count(F.lit(1)).alias("many")))
    # a point's id may stand in two labels (repeated ids); the place in the written table cannot
    points = materialize(points.withColumn("row", F.monotonically_increasing_id()))
    largest = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    anchors, sets, need = plan(largest, cosine, lines, half)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(b.schema.get_field_index("dim")).to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = matrix(part.column(part.schema.get_field_index("v")))
                rng = np.random.default_rng([seed, int(d)])
                g, far = rng.standard_normal((int(d), lines)), rng.standard_normal((int(d), anchors * sets))
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                at = np.floor((unit @ far) / WIDTH + rng.uniform(0, 1, anchors * sets)).astype(np.int64).view(np.uint64)
                cells = np.zeros((len(x), sets), np.uint64)
                for i in range(anchors):
                    cells = mix(cells * np.uint64(0x9E3779B97F4A7C15) + at[:, i::anchors] + np.uint64(1))
                arrays = [pa.array(list((unit @ g).astype(np.float32)), pa.list_(pa.float32())), pa.array(list(cells.view(np.int64)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, "p", "cells"])

    on_lines = materialize(points.mapInArrow(project, "label string, dim int, v array<double>, point long, many long, row long, p array<float>, cells array<long>"))
    keys = ["tab", "label", "dim", "cell"]
    homes = on_lines.select("label", "dim", "row", F.posexplode("cells").alias("tab", "cell"))
    sizes = homes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    dealt = homes.join(checked_broadcast(materialize(sizes)), keys).withColumn("own", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    jobs = dealt.select(*keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("asks"), "row")
    jobs = jobs.join(on_lines.select("row", "many", "v", "p", "cells"), "row")

    def count(t: pa.Table) -> pa.Table:
        tab, alone = t.column("tab")[0].as_py(), t.column("low")[0].as_py() == t.column("high")[0].as_py()
        asking = t.column("asks").to_numpy()
        h = t.filter(pa.array(~asking))
        q = h if alone else t.filter(pa.array(asking))
        row, total, src, dst = [], [], [], []
        if h.num_rows and q.num_rows:
            read = lambda s: [matrix(s.column("v")), matrix(s.column("p")), matrix(s.column("cells"))[:, :tab], s.column("row").to_numpy(), s.column("many").to_numpy()]
            unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
            hx, hp, hc, hrow, hmany = read(h)
            qx, qp, qc, qrow, qmany = (hx, hp, hc, hrow, hmany) if alone else read(q)
            hu, qu = unit(hx), unit(qx)
            root, seen = np.arange(len(hrow)), np.zeros(len(hrow), np.int64)
            step = max(1, 250_000 // len(hrow))
            for a in range(0, len(qrow), step):
                hits = np.zeros((len(qp[a : a + step]), len(hp)), np.int8)
                for j in range(min(FIRST_LINES, lines)):
                    hits += np.abs(qp[a : a + step, j, None] - hp[None, :, j]) <= half
                possible = hits >= need - max(0, lines - FIRST_LINES)
                if alone:  # each pair once
                    possible &= np.arange(len(hp))[None, :] > np.arange(a, a + len(hits))[:, None]
                qi, hi = np.nonzero(possible)
                n = hits[qi, hi] + (np.abs(qp[a + qi, FIRST_LINES:] - hp[hi, FIRST_LINES:]) <= half).sum(1)
                ok = (n >= need) & ~(qc[a + qi] == hc[hi]).any(1)
                qi, hi = qi[ok] + a, hi[ok]
                cos = (qu[a : a + step] @ hu.T)[qi - a, hi]
                for i in np.flatnonzero(np.abs(cos - cosine) < 1e-9).tolist():  # so near the threshold that the order of summation could matter
                    x, y = qx[qi[i]], hx[hi[i]]
                    cos[i] = float(np.dot(x, y) / (math.sqrt((x**2).sum()) * math.sqrt((y**2).sum())))
                qi, hi = qi[cos >= cosine], hi[cos >= cosine]
                np.add.at(seen, hi, qmany[qi])
                new = np.flatnonzero(np.diff(qi, prepend=-1))
                for i, at in zip(qi[new].tolist(), np.split(hi, new[1:]) if len(new) else []):
                    row.append(qrow[i])
                    total.append(int(hmany[at].sum()))
                    groups, first = np.unique(root[at], return_index=True)
                    src += [qrow[i]] * len(first)
                    dst += hrow[at[first]].tolist()
                    if len(groups) > 1:
                        root[np.isin(root, groups)] = groups[0]
            some = np.flatnonzero(seen)
            row += hrow[some].tolist()
            total += seen[some].tolist()
        kind = [0] * len(row) + [1] * len(src)
        return pa.table({"kind": pa.array(kind, pa.int32()), "row": pa.array(row + src, pa.int64()), "other": pa.array(total + dst, pa.int64())})

    found = materialize(jobs.groupBy(*keys, "low", "high").applyInArrow(count, "kind int, row long, other long"))
    links = found.where("kind = 0").groupBy("row").agg(F.sum("other").alias("links"))
    edges = found.where("kind = 1").select(F.col("row").alias("src"), F.col("other").alias("dst"))
    comp = materialize(connected_components(edges).withColumnRenamed("node", "row"))
    members = points.select("row", "point").join(comp, "row").groupBy("component").agg(F.min("point").alias("component_id"))
    about = points.join(links, "row", "left").join(comp, "row", "left").join(checked_broadcast(materialize(members)), "component", "left").select(F.col("label").alias("_l"), F.col("v").alias("_v"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component_id", "point").alias("_component"))
    all_rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    out = all_rows.join(about, (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")) & F.col("vec_id").isNotNull(), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("_component", "vec_id"))
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
