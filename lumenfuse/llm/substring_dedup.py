"""Substring dedup by fixed-block anchors: word runs that an earlier document has already are removed.

1. Every document is cut into non-overlapping blocks of ``window // 2`` words, the reference index, and every
   rolling window of that many words is probed against it.  A run of ``window`` words always holds a whole block, so
   a run that stands in two documents gives a hit in each.  Index and probes meet in the key counts (see
   keycount.py): one compact shuffle, from which two bitmaps of bounded size are broadcast, blocks that repeat and
   rolling windows that repeat.  They can only add candidates by chance, never lose one.
2. Hits are extended to both sides as long as the rolling windows repeat somewhere, which gives maximal runs.  From
   here on runs are handled as intervals of a row, not as windows.
3. Runs of the same words (a 128-bit hash of the whole run) are one class.  In all but the class's smallest
   doc_id the whole run goes; copies and passages of any number end here, by a map-side aggregation.
4. What two different runs share is found on one run of each class only: its windows of ``window`` words meet by a
   128-bit hash, the smallest doc_id of each window wins, and the windows that lose become intervals of the class.

Words are hashed to 128 bits and windows, runs and texts by both halves apart, so a chance equality
needs two independent 64-bit collisions.  Rows are known by doc_id and a 128-bit hash of the text, so rows that share an id keep
their own cuts, and rows that are equal in both get the same.

Edge cases: null text has no words; fewer than ``window`` words: nothing is removed; a null doc_id is an id
that sorts before all others; rows of one doc_id (null among them) do not remove from each other; a long text is split piece by
piece, and its hashes (16 bytes a word) are what a task holds of it; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfuse.llm import common as C
from lumenfuse.llm.keycount import KeyCounts, count_keys

WINDOW = 50
_NO_ID = -(2**63)
#: Run texts that a task remembers to have sent already.
_SENT = 100_000
#: Rows and bytes up to which spans are broadcast, larger than elsewhere: it spares a shuffle of all texts.
SPARED = 1_000_000, 32_000_000


def _places(lens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of k words may start in the chain of all words: (place, place inside the row)."""
    inside = np.arange(lens.sum()) - np.repeat(C.starts_of(lens), lens)
    ok = np.flatnonzero(inside + k <= np.repeat(lens, lens))
    return ok, inside[ok]


def _spans(places: np.ndarray) -> np.ndarray:
    """(first, last) of each series of consecutive numbers in a sorted array."""
    new = np.flatnonzero(np.diff(places, prepend=places[:1] - 2) != 1)
    return np.stack([places[new], places[np.append(new[1:], len(places)) - 1]], 1) if len(places) else np.empty((0, 2), np.int64)


def _keyed(documents: DataFrame) -> DataFrame:
    """(own_id, doc_id, k1, k2, text): the id as it is, what the row is known by, and its text as bytes."""
    own, text = F.col("doc_id").cast("long"), F.col("text").cast("binary")
    return documents.select(own.alias("own_id"), F.coalesce(own, F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("text"))


def repeated_runs(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, k1, k2, start, n, r1, r2, words): maximal runs of n words whose windows may all stand elsewhere; written.

    r1 and r2 are a hash of the run; ``words`` is its text, null where the task has sent the same before.
    """
    block = window // 2
    rows = _keyed(documents)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for _, w, lens in C.chunks_of_words(batches):
            h = C.window_hashes(w[:, 0], block)
            at, inside = _places(lens, block)
            yield [h[at], h[at[inside % block == 0]]]

    known = documents.sparkSession.sparkContext.broadcast(count_keys(rows.select("text"), hashes, kinds=2))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info: KeyCounts = known.value
        sent: set[bytes] = set()
        for b, w, lens in C.chunks_of_words(batches):
            h = C.window_hashes(w[:, 0], block)
            at, _ = _places(lens, block)
            again, anchor = np.zeros(len(w), bool), np.zeros(len(w), bool)
            again[at] = info.repeated(h[at], 0)
            anchor[at] = again[at] & info.repeated(h[at], 1)
            # a window is kept if all its rolling blocks repeat and one of them is an indexed block
            width = window - block + 1
            s_again, s_anchor = (np.cumsum(np.concatenate(([0], x.astype(np.int64)))) for x in (again, anchor))
            start, _ = _places(lens, window)
            start = start[(s_again[start + width] - s_again[start] == width) & (s_anchor[start + width] > s_anchor[start])]
            ends = np.cumsum(lens)
            row = np.searchsorted(ends, start, "right")
            # places of different rows are never consecutive: a row's last window starts window - 1 words before its end
            found = _spans(start)
            at_row = row[np.searchsorted(start, found[:, 0])] if len(found) else np.empty(0, np.int64)
            text, cols = b.column(b.schema.get_field_index("text")), [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "k1", "k2")]
            out: list[list] = []
            new: dict[int, list[int]] = {}
            for r, (first, end) in zip(at_row.tolist(), found.tolist()):
                digest = xxhash.xxh3_128_digest(w[first : end + window].tobytes())
                if digest not in sent:
                    if len(sent) >= _SENT:
                        sent.clear()
                    sent.add(digest)
                    new.setdefault(r, []).append(len(out))
                out.append([*(int(c[r]) for c in cols), first - int(ends[r] - lens[r]), end + window - first, *np.frombuffer(digest, np.int64).tolist(), None])
            for r, which in new.items():
                for i, piece in zip(which, C.word_slices(text[r].as_py(), [(out[i][3], out[i][3] + out[i][4]) for i in which])):
                    out[i][7] = piece
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 7 else pa.int64()) for i, c in enumerate(zip(*out))], names=["doc_id", "k1", "k2", "start", "n", "r1", "r2", "words"])

    out = C.materialize(rows.mapInArrow(C.lean(runs), "doc_id long, k1 long, k2 long, start long, n long, r1 long, r2 long, words binary"))
    known.destroy()
    return out


def removed_spans(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, k1, k2, spans array<struct<start, end>>): what goes of each row that loses words; written."""
    runs = repeated_runs(documents, window)
    classes = runs.groupBy("r1", "r2").agg(F.min("doc_id").alias("low"), F.max("words").alias("words"))
    classes = C.materialize(classes.withColumn("run", F.monotonically_increasing_id()))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, w, lens in C.chunks_of_words(batches, "words"):
            start, inside = _places(lens, window)
            of = np.repeat(np.arange(len(lens)), lens)[start]
            halves = [pa.array(C.signed(C.window_hashes(np.ascontiguousarray(w[:, i]), window)[start])) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*halves, *(b.column(b.schema.get_field_index(c)).take(pa.array(of)) for c in ("low", "run")), pa.array(inside)], names=["h1", "h2", "low", "run", "start"])

    cand = C.materialize(classes.select("low", "run", "words").mapInArrow(C.lean(windows), "h1 long, h2 long, low long, run long, start long"))
    first = cand.groupBy("h1", "h2").agg(F.min("low").alias("first"), F.max("low").alias("last")).where("first < last").select("h1", "h2", "first")
    lost = cand.join(first, ["h1", "h2"]).where("low > first").select("run", "start")

    # a run's own places; its length bounds them
    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            places = b.column(b.schema.get_field_index("places"))
            spans = [[{"start": x, "end": y + window} for x, y in _spans(np.unique(places[i].values.to_numpy())).tolist()] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("run")), pa.array(spans, kind)], names=["run", "cuts"])

    cuts = lost.groupBy("run").agg(F.collect_list("start").alias("places")).mapInArrow(C.lean(intervals), "run long, cuts array<struct<start: long, end: long>>")
    about = C.materialize(classes.select("r1", "r2", "low", "run").join(cuts, "run", "left").select("r1", "r2", "low", "cuts"))
    of_runs = runs.select("doc_id", "k1", "k2", "start", "n", "r1", "r2").join(C.checked_broadcast(about, *SPARED), ["r1", "r2"])
    whole = F.array(F.struct(F.col("start"), (F.col("start") + F.col("n")).alias("end")))
    moved = F.transform("cuts", lambda x: F.struct((x["start"] + F.col("start")).alias("start"), (x["end"] + F.col("start")).alias("end")))
    spans = of_runs.select("doc_id", "k1", "k2", F.explode(F.when(F.col("doc_id") > F.col("low"), whole).otherwise(moved)).alias("span"))
    return C.materialize(spans.groupBy("doc_id", "k1", "k2").agg(F.sort_array(F.collect_set("span")).alias("spans")))


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, removed array<struct<start, end>> (word positions), kept_text.

    kept_text: the words that stay, joined by one space.
    """
    spans = removed_spans(documents, window)
    joined = _keyed(documents).join(C.checked_broadcast(spans, *SPARED), ["doc_id", "k1", "k2"], "left").select("own_id", "text", "spans")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, found, texts = [], [], [], []
            text, lists = b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("spans"))
            for i in range(b.num_rows):
                t = text[i].as_py() or b""
                n.append(sum(len(p.split()) for p in C.pieces_of(t)))
                merged: list[list[int]] = []
                for s in lists[i].as_py() or []:
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                stay = list(zip([0, *(y for _, y in merged)], [*(x for x, _ in merged), n[-1]]))
                gone.append(sum(y - x for x, y in merged))
                found.append([{"start": x, "end": y} for x, y in merged])
                texts.append(b" ".join(p for p in C.word_slices(t, stay) if p))
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("own_id")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "removed", "kept"],
            )

    out = joined.mapInArrow(C.lean(cut), "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept binary")
    return out.select("doc_id", "n_words", "n_removed", "removed", F.col("kept").cast("string").alias("kept_text"))
