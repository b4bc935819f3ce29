"""Best-fit packing of token sequences: best-two-fit.

A bin is filled greedily, largest fitting piece first; then its smallest piece is given back if two unpacked
pieces fill the widened gap more tightly.  Working on counts per length (1..limit) a bin costs a few vector
operations whatever the number of pieces.

Pieces are dealt to shards of bounded size by a hash, each packed by one task: a hot source or a group of
copies is spread like any other rows.  Shards are large (SHARD pieces), so the last, partly filled bin of
each is all that sharding costs.  Pieces of the full length are bins of their own and are not dealt at all.

Texts are tokenized in batches of bounded bytes, a longer one piece by piece; a task then holds one text's ids besides.

Edge cases: null or empty text is its end mark alone (one token); texts longer than the limit are cut into
pieces of the limit; repeated rows are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfuse.llm.common import give_back, lean, materialize, pieces_of

LIMIT, END_ID, SHARD = 2048, 0, 50_000
#: Rows and bytes of texts that are tokenized at once.
BATCH_ROWS, BATCH_BYTES = 500, 1_000_000

#: Where an ASCII letter meets punctuation, the tokenizer parts them (the mark comes first: a search for it is quick).
_MARKS = b".,;:!?%#$&*"
_EDGE = re.compile(rb"[%s](?<=[A-Za-z].)" % _MARKS)
#: Words kept by a worker, their greatest length in bytes, and how often one may be missing before it starts anew.
MAX_WORDS, LONG_WORD, MAX_MISSES = 150_000, 64, 1_200_000
#: Letters below this code point are their own NFC form.
_PLAIN = chr(0x250)


class WordIds(dict):
    """Token ids, as little-endian uint32 bytes, of words (bytes without ASCII white space).

    The tokenizer drops white space and case, its merges never cross white space, and it parts letters from
    punctuation, so a text's ids are those of its parts in a row (tests compare with whole texts).  The first
    MAX_WORDS parts are kept for later batches and tasks of the same Python worker: as frequent words come
    early, that misses less than to forget all whenever it is full.  After MAX_MISSES it does forget, as texts change.
    """

    def __init__(self, tokenizer):
        super().__init__()
        from tokenizers import pre_tokenizers

        self.tokenizer, self.one_word, self.missed = tokenizer, tokenizer.model.tokenize, 0
        self.as_bytes = [i.to_bytes(4, "little") for i in range(max(tokenizer.get_vocab().values(), default=-1) + 1)]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, ord(_PLAIN))}

    @staticmethod
    def parts(text: bytes) -> list[bytes]:
        if b"<|" in text:  # may hold a special token, whose case counts
            return text.split()
        return _EDGE.sub(rb" \g<0>", text.lower()).split()

    def letters(self, word: bytes) -> bytes | None:
        """Ids of one run of letters, straight from the merges; None if the word is something else."""
        if word.isalpha():  # ASCII
            low = word.lower().decode()
        else:
            low = word.decode(errors="replace").lower()
            if not low.isalpha() or max(low) >= _PLAIN:
                return None
            low = low.translate(self.bytes_of)
        return b"".join([self.as_bytes[t.id] for t in self.one_word(low)])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.letters(word)
        if ids is None and (run := word.rstrip(_MARKS)) and run != word and (ids := self.letters(run)) is not None:
            ids += self[word[len(run) :]]
        if ids is None:
            found = self.tokenizer.encode(word.decode(errors="replace"), add_special_tokens=False).ids
            ids = np.array(found, "<u4").tobytes()
        self.missed += 1
        if self.missed > MAX_MISSES:
            self.clear()
            self.missed = 0
        if len(self) < MAX_WORDS and len(word) <= LONG_WORD:
            self[word] = ids
        return ids

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; a text of more than BATCH_BYTES goes piece by piece."""
        if len(texts) == 1 and len(texts[0]) > BATCH_BYTES:
            return [b"".join(self._ids(pieces_of(texts[0], BATCH_BYTES // 2)))]
        return self._ids(texts)

    def _ids(self, texts: Iterable[bytes]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, self.parts(t))) for t in texts]


def _batches(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows (first, end) of at most BATCH_ROWS texts and, unless one alone is longer, BATCH_BYTES."""
    first, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
        if i > first and (held + n > BATCH_BYTES or i - first >= BATCH_ROWS):
            yield first, i
            first, held = i, 0
        held += n
    if first < len(text):
        yield first, len(text)


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
    return WordIds(Tokenizer.from_file(path))


def tokenize(documents: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False, by_word: bool = True) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of whole texts, end mark included.

    ``by_word`` says that the tokenizer works as WordIds asks; otherwise whole texts are encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _word_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc, text = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text"))
            for first, end_row in _batches(text):
                out: list[tuple] = []
                ids_out: list[bytes] = []
                texts = [t or b"" for t in text.slice(first, end_row - first).to_pylist()]
                if by_word:
                    all_ids = words.ids(texts)
                else:
                    all_ids = [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch([t.decode(errors="replace") for t in texts], add_special_tokens=False)]
                for d, ids in zip(doc.slice(first, end_row - first).to_pylist(), all_ids):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * limit)):
                        part = ids[start : start + 4 * limit]
                        out.append((d, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                        if with_ids:
                            ids_out.append(part)
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    ends = np.cumsum([0, *(len(part) // 4 for part in ids_out)], dtype=np.int32)  # as many as texts of BATCH_BYTES, or one text, have
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids_out), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), schema)


def digests(packed: DataFrame) -> DataFrame:
    """``packed`` with length and ids_crc32 (of the little-endian uint32 bytes) taken from its ``ids``, which it gives up."""
    names = [c for c in packed.columns if c not in ("ids", "length", "ids_crc32")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index("ids"))
            ids, ends = col.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))
            crc = [zlib.crc32(p) for p in np.split(ids, ends[:-1])] if b.num_rows else []
            arrays = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, col.value_lengths().cast(pa.int64()), pa.array(crc, pa.int64())], names=[*names, "length", "ids_crc32"])

    schema = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in names) + ", length long, ids_crc32 long"
    return packed.select(*names, "ids").mapInArrow(lean(run), schema)


def best_two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece, and the number of bins."""
    n = np.bincount(lengths, minlength=limit + 1)
    order = np.argsort(lengths, kind="stable")
    last = np.cumsum(n)  # pieces of length x: order[last[x] - n[x] : last[x]], taken from the end
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, count = len(lengths), 0
    fits = np.maximum.accumulate(np.where(n > 0, np.arange(limit + 1), 0))  # largest unpacked length up to x

    def use(x: int) -> None:
        n[x] -= 1
        if n[x] == 0:
            was = fits[x - 1] if x else 0
            end = x + int(np.argmax(fits[x:] != x)) if fits[-1] != x else limit + 1
            fits[x:end] = was

    def give_back(x: int) -> None:
        n[x] += 1
        if n[x] == 1:
            part = fits[x:]
            part[part < x] = x

    while left:
        gap, held = limit, []
        while gap and (x := int(fits[gap])):
            use(x)
            held.append(x)
            gap -= x
        if gap and len(held) > 1:
            small = held[-1]
            wide = gap + small
            a = np.arange(1, wide // 2 + 1)
            other = fits[wide - a]
            other = np.where((other == a) & (n[a] < 2), fits[np.maximum(a - 1, 0)], other)
            pair = np.where((n[a] > 0) & (other > 0), a + other, 0)
            at = int(np.argmax(pair)) if len(pair) else 0
            if len(pair) and pair[at] > small:
                held.pop()
                use(int(a[at]))
                use(int(other[at]))
                held += [int(other[at]), int(a[at])]
                give_back(small)
        offset = 0
        for x in held:
            last[x] -= 1
            i = order[last[x]]
            bins[i], offsets[i] = count, offset
            offset += x
        left -= len(held)
        count += 1
    return bins, offsets, count


def pack(pieces: DataFrame, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """``pieces`` (with a column ``length`` of at most ``limit``) plus sequence_id and offset, gapless from 0."""
    # ids of rows must not change if a task runs again: cut here
    rows = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()))
    full = rows.where(F.col("length") >= limit).select("*", (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = rows.where(F.col("length") < limit)
    shards = max(1, -(-part.count() // shard))
    keyed = part.select("_row", F.col("length").cast("long").alias("length"), F.pmod(F.xxhash64("_row"), F.lit(shards)).alias("_shard"))

    def run(t: pa.Table) -> pa.Table:
        s = t.column("_shard")[0].as_py()
        order = np.argsort(t.column("_row").to_numpy())  # the same packing whatever the order of arrival
        t = t.take(pa.array(order))
        bins, offsets, _ = best_two_fit(t.column("length").to_numpy().astype(np.int64), limit)
        give_back()
        return pa.table({"_row": t.column("_row"), "sequence_id": pa.array(bins + (s << 32)), "offset": pa.array(offsets)})

    placed = keyed.groupBy("_shard").applyInArrow(run, "_row long, sequence_id long, offset long")
    return part.join(placed, "_row").select(*rows.columns, "sequence_id", "offset").union(full.select(*rows.columns, "sequence_id", "offset")).drop("_row")
