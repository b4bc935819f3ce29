"""Language ID by rank-order profiles (Cavnar and Trenkle 1994).

A profile lists a language's most frequent letter n-grams (1 to 3 characters, words padded by a blank) in
order.  A document's own list is compared with each profile by out-of-place distance: how far each n-gram is from its place,
MISSING if the profile lacks it.  The nearest profile names the language; the score is
1 - distance / largest distance.

Profiles are learned from labelled rows only: every distinct text of a language once, up to about TRAIN_DOCS of them, beyond
which a hash of the text picks that share of the distinct texts (a bounded sample, the only one here).  So copies have no weight, and
a language with a labelled text that has a letter always has a profile.  Counts are combined map-side and the profiles (languages times
PROFILE n-grams) are broadcast.

Edge cases: null text or text without a letter is ``und`` with score 0; without any profile every row is
``und``; equal distances go to the language first by code point; n-grams of equal count are ordered by
code points; rows without a language are not learned from; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lumenfuse.llm.common import lean

PROFILE, TRAIN_DOCS, UNKNOWN = 300, 5000, "und"
#: Rows of one language are counted together until they have this many n-grams.
HELD_GRAMS = 1_000_000
_BLANK = np.int64(32)
_letters = np.array([c.isalpha() for c in map(chr, range(0x3000))])


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-case text with every other character than a letter as a blank, no two blanks in a row."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    low = a < len(_letters)
    letter = np.zeros(len(a), bool)
    letter[low] = _letters[a[low]]
    if not low.all():
        far, back = np.unique(a[~low], return_inverse=True)
        letter[~low] = np.array([chr(c).isalpha() for c in far.tolist()])[back]
    a = np.where(letter, a, _BLANK)
    a = np.concatenate(([_BLANK], a, [_BLANK]))
    return a[np.concatenate(([True], (a[1:] != _BLANK) | (a[:-1] != _BLANK)))]


def gram_codes(text: str | None) -> np.ndarray:
    """The text's n-grams, each as one integer of three code points; empty if it has no letter."""
    if not text:
        return np.empty(0, np.int64)
    a = _codes(text)
    if len(a) < 2:
        return np.empty(0, np.int64)
    two, three = (a[:-1] << 21) | a[1:], (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    middle = a[1:-1] != _BLANK  # none across words
    return np.concatenate((a[a != _BLANK], two, three[middle]))


def top_grams(grams: np.ndarray, size: int) -> np.ndarray:
    """The most frequent, most frequent first."""
    g, n = np.unique(grams, return_counts=True)
    if len(g) > size:  # those of at least the size-th count, ties included, before sorting
        floor = np.partition(n, len(n) - size)[len(n) - size]
        g, n = g[n >= floor], n[n >= floor]
    return g[np.argsort(-n, kind="stable")][:size]


def learn_profiles(labelled: DataFrame, size: int = PROFILE, train_docs: int = TRAIN_DOCS) -> list[tuple[str, list[int]]]:
    """Profiles of each language of ``labelled(text, lang)``, in code point order of the language."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}  # one row a language
    if not counts:
        return []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, train_docs / n)))])
    some = rows.where(F.pmod("h", F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    picked = some.groupBy("lang", "h").agg(F.any_value("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), object)
            text = b.column(1)
            for one in sorted(set(lang)):
                held, size_held, mine = [], 0, np.flatnonzero(lang == one)
                for i in mine.tolist():
                    held.append(gram_codes(text[i].as_py()))
                    size_held += len(held[-1])
                    if size_held >= HELD_GRAMS or i == mine[-1]:
                        g, n = np.unique(np.concatenate(held), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([one] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
                        held, size_held = [], 0

    summed = picked.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = summed.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "r").collect():  # languages times size rows
        out.setdefault(r["lang"], []).append(r["gram"])
    return sorted(out.items())


class Profiles:
    """Places of n-grams in every profile, for look-up by binary search."""

    def __init__(self, profiles: list[tuple[str, list[int]]], size: int):
        self.names, self.size = [k for k, _ in profiles], size
        self.grams = np.unique(np.concatenate([np.array(g, np.int64) for _, g in profiles])) if profiles else np.empty(0, np.int64)
        self.places = np.full((len(profiles), len(self.grams) + 1), -1, np.int64)
        for i, (_, g) in enumerate(profiles):
            self.places[i, np.searchsorted(self.grams, g)] = np.arange(len(g))

    def nearest(self, text: str | None) -> tuple[str, float]:
        grams = gram_codes(text)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        own = top_grams(grams, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        place = self.places[:, np.where(self.grams[at] == own, at, len(self.grams))]
        distance = np.where(place >= 0, np.abs(place - np.arange(len(own))), self.size).sum(1)
        i = int(np.argmin(distance))
        return self.names[i], float(1 - distance[i] / (self.size * len(own)))


def identify(documents: DataFrame, profiles: list[tuple[str, list[int]]], size: int = PROFILE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``documents`` with the predicted language and its score under ``names``; only ``text`` is looked at.

    Columns of these names must not be there yet.
    """
    if clash := {c.lower() for c in documents.columns} & {c.lower() for c in names}:
        raise ValueError(f"there are columns {sorted(clash)} already")
    known = documents.sparkSession.sparkContext.broadcast(Profiles(profiles, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Profiles = known.value
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            got = [p.nearest(text[i].as_py()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*b.schema.names, *names])

    schema = T.StructType([*documents.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return documents.mapInArrow(lean(run), schema)


def held_out(doc_id: Column, parts: int = 4, which: int = 2) -> Column:
    """Rows that profiles must not be learned from: crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))
