r"""Token counts without ids: pieces once per distinct pre-token, joined to each document's pre-token frequencies.

A byte-level BPE tokenizer parts a text into pre-tokens by a fixed pattern and merges inside a pre-token only, so a
text has as many tokens as its pre-tokens have pieces.  Three steps:

1. every document's distinct pre-tokens with their frequencies, written once (long texts go piece by piece).  They are turned
   round within a run of rows, so a pre-token stands there once for all of them;
2. the distinct pre-tokens of the whole corpus, encoded once each: the number of pieces is kept, ids are not;
3. frequencies joined to pieces and summed per document.  A pre-token that holds at least 1 in HEAVY of all
   (document, pre-token) pairs is heavy: there are at most HEAVY of them, and their table is broadcast if it is as small as
   it should be.  All others are joined by a shuffle, in which no key has more than that share of the pairs.

Strings of special tokens inside a text are one token, as the tokenizer takes them by default.

Edge cases: null and empty texts have no tokens; texts of any length are counted whole; repeated rows and rows of one
doc_id are counted each; a null doc_id stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfuse.llm.common import checked_broadcast, lean, materialize

#: A pre-token is heavy if it holds at least 1 in HEAVY of all (document, pre-token) pairs; bytes up to which the table of heavy ones is broadcast.
HEAVY, HEAVY_BYTES = 1_000_000, 16_000_000
#: Characters of a text that are parted at once; (document, pre-token) pairs that a task holds; pre-tokens it gives out at once.
PIECE_CHARS, CHUNK_TOKENS, ROW_TOKENS = 1_000_000, 2_000_000, 50_000
#: Below this code point the pattern's classes are written out here; a text with a character above goes through the library.
PLAIN = 0x250


def _class(holds) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if holds(c))


_L, _N = (_class(lambda c, k=k: unicodedata.category(chr(c))[0] == k) for k in "LN")
_S = _class(lambda c: 9 <= c <= 13 or c in (0x20, 0x85, 0xA0))
# The public pre-token pattern of byte-level BPE, for characters below PLAIN.
_PATTERN = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: One blank between two characters that are not white space: a pre-token always ends before it.
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


class PreTokens:
    """Pre-tokens and piece counts of one tokenizer file."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre, special = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError("counting by pre-tokens needs a byte-level tokenizer without normalizer, prefix blank or special tokens that take in what is around them")
        names = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def part(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if text.isascii() or ord(max(text)) < PLAIN:
            return _PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> Counter:
        out: Counter = Counter()
        for i, plain in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:  # a special string, one token by itself
                out[plain] += 1
                continue
            at = 0
            while at < len(plain):
                cut = _BOUNDARY.search(plain, at + PIECE_CHARS)
                end = cut.start() if cut else len(plain)
                out.update(self.part(plain[at:end]))
                at = end
        return out

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(pre_tokens, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _pre_tokens(path: str) -> PreTokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
    return PreTokens(path)


class _Index(dict):
    """Numbers in order of first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class _Chunk:
    """Frequencies of some rows in a run, turned round: each distinct pre-token with the rows that hold it."""

    def __init__(self, first: int):
        self.first, self.index = first, _Index()
        self.rows, self.docs, self.sizes = [], [], []  # one entry a row
        self.ids, self.counts, self.lens = array("i"), array("i"), array("i")  # pre-tokens, row by row

    def add(self, row: int, doc: int | None, text: bytes | None, own: PreTokens) -> None:
        n = own.count(text.decode(errors="replace")) if text else {}
        self.rows.append(row - self.first)
        self.docs.append(doc)
        self.sizes.append(len(text or b""))
        self.ids.extend(map(self.index.__getitem__, n))
        self.counts.extend(n.values())
        self.lens.append(len(n))

    def batches(self) -> Iterator[pa.RecordBatch]:
        one = lambda x: pa.array([x], pa.list_(pa.int32()))
        yield _record(pa.nulls(1, pa.string()), self.first, one(self.rows), one(self.sizes), pa.array([self.docs], pa.list_(pa.int64())))
        ids = np.array(self.ids, np.int64)
        order = np.argsort(ids, kind="stable")
        row, count = np.repeat(np.array(self.rows, np.int32), self.lens)[order], np.array(self.counts, np.int32)[order]
        ends, tokens = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(self.index))))), list(self.index)
        for at in range(0, len(tokens), ROW_TOKENS):
            cut = ends[at : at + ROW_TOKENS + 1]
            lists = [pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(x[cut[0] : cut[-1]])) for x in (row, count)]
            yield _record(pa.array(tokens[at : at + ROW_TOKENS], pa.string()), self.first, *lists, pa.nulls(len(cut) - 1, pa.list_(pa.int64())))


def _record(token: pa.Array, first: int, *lists: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([token, pa.array([first] * len(token), pa.int64()), *lists], names=["token", "first", "rows", "counts", "doc_ids"])


def frequencies(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """(token, first, rows, counts, doc_ids): how often a pre-token is in each text, turned round within some rows that follow each other.

    Row ``first + rows[i]`` of ``documents`` holds the pre-token ``counts[i]`` times.  A null token stands for the rows themselves: ``counts`` are their
    bytes, ``doc_ids`` their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk = _pre_tokens(tokenizer_path), None
        for b in batches:
            row, doc, text = (b.column(b.schema.get_field_index(c)) for c in ("row", "doc_id", "text"))
            for i in range(b.num_rows):
                chunk = chunk or _Chunk(row[i].as_py())
                chunk.add(row[i].as_py(), doc[i].as_py(), text[i].as_py(), own)
                if len(chunk.ids) >= CHUNK_TOKENS or len(chunk.rows) >= CHUNK_TOKENS:
                    yield from chunk.batches()
                    chunk = None
        if chunk:
            yield from chunk.batches()

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "token string, first long, rows array<int>, counts array<int>, doc_ids array<long>")


def piece_table(freq: DataFrame, tokenizer_path: str) -> DataFrame:
    """(token, rows, pieces): each distinct pre-token of ``freq``, in how many documents it is, and its number of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pre_tokens(tokenizer_path)
        for b in batches:
            n = own.pieces(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["token", "rows", "pieces"])

    distinct = freq.where("token is not null").groupBy("token").agg(F.sum(F.size("rows")).alias("rows"))
    return distinct.mapInArrow(lean(run), "token string, rows long, pieces long")


def count_tokens(documents: DataFrame, tokenizer_path: str, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per row of ``documents``."""
    freq = materialize(frequencies(documents, tokenizer_path))  # ids of rows must not change if a task runs again
    table = materialize(piece_table(freq, tokenizer_path))
    least = -(-(table.agg(F.sum("rows")).first()[0] or 0) // heavy)
    some, rest = (table.where(F.col("rows") >= least), table.where(F.col("rows") < least)) if least > 1 else (table, None)
    known = checked_broadcast(some.select("token", "pieces"), heavy, HEAVY_BYTES)
    joined = freq.where("token is not null").select("token", "first", "rows", "counts").join(known, "token", "left")
    rows = freq.where("token is null").select("first", F.explode(F.arrays_zip("rows", "counts", "doc_ids")).alias("x"))
    parts = [rows.select((F.col("first") + F.col("x.rows")).alias("row"), F.col("x.doc_ids").alias("doc_id"), F.col("x.counts").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"))]

    def summed(df: DataFrame) -> DataFrame:
        each = df.select("first", "pieces", F.explode(F.arrays_zip("rows", "counts")).alias("x"))
        return each.select((F.col("first") + F.col("x.rows")).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_bytes"), (F.col("x.counts") * F.col("pieces")).alias("n_tokens"))

    parts.append(summed(joined.where("pieces is not null")))
    if rest is not None:
        parts.append(summed(joined.where("pieces is null").drop("pieces").join(rest.select("token", "pieces"), "token")))
    out = reduce(DataFrame.union, parts)
    return out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")).drop("row")
