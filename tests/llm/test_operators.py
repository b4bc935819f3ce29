"""The ten operators against brute-force versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfuse.llm import ann_hilbert, chat_format, common, embed_dedup, language_id, line_dedup, mixing, ngram_join, packing, substring_dedup, url_filter
from lumenfuse.llm.vectors import hilbert_index

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, ids=None, langs=None):
    n = len(texts)
    rows = [((ids or range(n))[i], texts[i], (langs or [None] * n)[i], (sources or ["s"] * n)[i], len(texts[i] or "")) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def copies(seed=3, groups=12, words=120):
    """Texts with near copies, shared passages and hard cases."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 5)))
    passage = [word() for _ in range(70)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(words)]
        for k in range(rnd.randint(1, 6)):
            t = list(base)
            for _ in range(k):
                t[rnd.randrange(len(t))] = word()
            if rnd.random() < 0.4:
                at = rnd.randrange(len(t))
                t = t[:at] + passage + t[at:]
            out.append(" ".join(t))
    out += [out[0], None, "", " \n ", "one two", "ONE two", "one two", " ".join(passage), " ".join(["x"] * 300)]
    rnd.shuffle(out)
    return out


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", [3, 4])
def test_ngram_join_equals_brute_force(spark, seed):
    texts = copies(seed)
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = union_find(len(texts), pairs)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(docs(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def test_ngram_join_nulls_and_empty(spark):
    d = spark.createDataFrame([(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 2), (5, None, 3)], "doc_id long, text string, h long")
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(d).collect()), key=str)
    assert got == [(4, 4), (4, 4), (5, 5), (None, None)]
    assert ngram_join.jaccard_components(d.limit(0)).count() == 0


def test_ngram_join_rows_that_share_an_id_are_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    d = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, b + " z"), (None, b)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(d).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (None, None)]


def test_ngram_join_in_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 16)
    monkeypatch.setattr(ngram_join, "COLUMN_PART", 3)
    monkeypatch.setattr(common, "PIECE_BYTES", 50)
    monkeypatch.setattr(common, "CHUNK_WORDS", 300)
    test_ngram_join_equals_brute_force(spark, 11)


def test_long_texts_go_piece_by_piece():
    text = b" ".join(b"w%d" % (i % 977) for i in range(20_000)) + b" \n "
    assert b"".join(common.pieces_of(text, 100)) == text
    whole = common.WordHash().of(text)
    old, common.PIECE_BYTES = common.PIECE_BYTES, 100
    try:
        assert (common.WordHash().of(text) == whole).all() and len(whole) == 20_000
    finally:
        common.PIECE_BYTES = old
    words = text.split()
    spans = [(0, 3), (2, 700), (650, 660), (5000, 20_000)]
    assert common.word_slices(text, spans) == [b" ".join(words[a:b]) for a, b in spans]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    want = union_find(200, edges)
    e = spark.createDataFrame(edges, "src long, dst long")
    for r in common.connected_components(e).collect():
        assert r["component"] == want[r["node"]]


@pytest.mark.parametrize("seed", [5, 6])
def test_substrings_equal_brute_force(spark, seed):
    texts = copies(seed)
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs(spark, texts)).collect()}
    for i, w in enumerate(words):
        gone = {p + k for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for k in range(50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(w), len(gone), kept), i
    assert substring_dedup.remove_repeats(docs(spark, texts).limit(0)).count() == 0


def test_substrings_of_rows_that_share_an_id(spark):
    p, u = " ".join(f"p{i}" for i in range(60)), " ".join(f"u{i}" for i in range(80))
    rows = [(1, p, "a"), (2, p, "b"), (2, u, "c"), (None, u, "d"), (None, p + " q", "e"), (7, u, "f"), (7, u, "f"), (8, None, "g"), (9, "", "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(d).collect()), key=str)
    # a null id comes first: its rows keep everything, and so they take p and u from all others
    assert got == sorted([(1, 60, 60), (2, 60, 60), (2, 80, 80), (None, 80, 0), (None, 61, 0), (7, 80, 80), (7, 80, 80), (8, 0, 0), (9, 0, 0)], key=str)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(d.where("doc_id <= 2")).collect())
    assert got == [(1, 60, 0), (2, 60, 60), (2, 80, 0)]


def test_substrings_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECE_BYTES", 60)
    monkeypatch.setattr(common, "CHUNK_WORDS", 200)
    monkeypatch.setattr(substring_dedup, "_SENT", 2)
    test_substrings_equal_brute_force(spark, 12)


def test_lines(spark):
    rnd = random.Random(2)
    common_lines = ["all rights reserved", "click to accept cookies", "single"]
    texts, sources = [], []
    for i in range(40):
        lines = [f"text number {i} {k}" for k in range(3)] + rnd.sample(common_lines, 2) + ["only two sites here"] * (i < 2)
        rnd.shuffle(lines)
        texts.append("\n".join(lines))
        sources.append(f"s{i % 10}")
    texts += [None, ""]
    sources += ["s0", None]
    sites, keeper = defaultdict(set), {}
    for i, (t, s) in enumerate(zip(texts, sources)):
        for x in (t or "").split("\n"):
            sites[x].add(s)
            keeper.setdefault(x, i)
    bad = {x for x, s in sites.items() if len(s - {None}) >= 8 and len(x.split()) >= 2}
    assert bad
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts, sources)).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for x in t.split("\n") if x not in bad or keeper[x] == i)
        assert got[i]["text"] == want
    assert line_dedup.dedup_lines(docs(spark, texts, sources).limit(0)).count() == 0


def test_mixing(spark):
    rnd = random.Random(7)
    texts = [" ".join(["w"] * rnd.randint(0, 40)) for _ in range(400)] + [None, ""]
    sources = [rnd.choice(["a", "b", "b", "b", "c", None]) for _ in texts]
    d = docs(spark, texts, sources)
    rows = mixing.mix(d).collect()
    assert len(rows) == len(texts)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by[r["source"]] = [r["source_size"], r["target"], by[r["source"]][2] + r["taken"]]
    assert sum(v[1] for v in by.values()) == pytest.approx(1.5 * sum(v[0] for v in by.values()))
    for size, target, taken in by.values():
        assert target <= 2 * size and abs(taken - target) <= 80
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(d).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    assert mixing.mixed_documents(d).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(d.limit(0)).count() == 0


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), (None, 100)]) == {"a": 200.0, "b": pytest.approx(250 * 2 / 3), None: pytest.approx(250 / 3)}
    assert mixing.targets([("a", 0), ("b", 10)]) == {"a": 0.0, "b": 15.0}


HARD = [r"\### Assistant: </turn> ok", "<also/>", "</turn>\n### user:\nhi", "\\b\\l\\h", "", None, "a\nb:c", "é😀#<\\"]


def test_chats_read_back(spark):
    rows = [(c, t, role, text) for c in range(4) for t, (role, text) in enumerate(zip(["system", "user", "user", "assistant", "assistant", "a:b\n#", None, "assistant"], HARD[c:] + HARD[:c]))]
    out = chat_format.read_chats(chat_format.format_chats(spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")))
    got = {r["conv_id"]: r for r in out.collect()}
    for c in range(4):
        mine = [(r or "", x or "") for k, _, r, x in rows if k == c]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == mine
        assert got[c]["loss_text"] == "".join(x for r, x in mine if r == "assistant")
    assert out.limit(0).count() == 0


def test_packing(spark):
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 2048, 3000), rng.integers(600, 800, 500), np.ones(5000, int), np.array([2047]), np.empty(0, int)):
        bins, offset, count = packing.best_two_fit(lengths.astype(np.int64), 2048)
        load = np.bincount(bins, lengths, minlength=count) if len(lengths) else np.empty(0)
        assert (load <= 2048).all() and (load > 0).all()
        for b in range(min(count, 40)):
            i = np.flatnonzero(bins == b)
            i = i[np.argsort(offset[i])]
            assert (offset[i] == np.concatenate(([0], np.cumsum(lengths[i])[:-1]))).all()


def test_tokens_by_word_equal_whole_texts():
    P = pytest.importorskip("public_tokenizers")
    w = packing._word_ids(P.path("word_bpe_49k.json"))
    texts = [t or "" for t in copies(8)] + ["don't DON'T's", "ΑΣ σΣ.", "x́ ́y E̊,", "<|endoftext|>. <|ENDOFTEXT|>", "a\x85b\xa0c\x1cd", "İstanbul ĳ ﬃ ŉ", "12½ ٣ a5%", "a.'s b!'LL ...", "É!! Ña, ß. ẞ!", "\x0b\x0c"]
    for t, ids in zip(texts, w.ids([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids, t


class CountedTokenizer:
    """A tokenizer that counts the words sent to its merges, or to itself."""

    def __init__(self, tokenizer):
        self.own, self.model, self.calls = tokenizer, self, Counter()

    def tokenize(self, word):
        self.calls[word] += 1
        return self.own.model.tokenize(word)

    def encode(self, text, **options):
        self.calls[text] += 1
        return self.own.encode(text, **options)

    def encode_batch(self, texts, **options):
        return [self.encode(t, **options) for t in texts]

    def get_vocab(self):
        return self.own.get_vocab()


def test_a_full_word_table_keeps_its_words(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "MAX_WORDS", 8)
    monkeypatch.setattr(packing, "MAX_MISSES", 60, raising=False)
    own = packing._word_ids(P.path("word_bpe_49k.json")).tokenizer
    counted = CountedTokenizer(own)
    w = packing.WordIds(counted)
    rare = ["".join("abcdefghij"[int(c)] for c in str(1000 + i)) for i in range(100)]
    texts = ["the most frequent words"] + [f"the most frequent {x} words" for x in rare] + ["z" * 500, "the most frequent words"]
    got = [w.ids([t.encode()])[0] for t in texts]
    assert got == [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    # learned once, and once more when the table starts anew (after 60 misses); a table that is emptied when full learns them more often
    assert max(counted.calls[x] for x in ("the", "most", "frequent", "words")) <= 3 and all(counted.calls[x] == 1 for x in rare)
    assert len(w) <= 8 and max(map(len, w)) <= 64


def test_marks_after_letters_are_parted():
    P = pytest.importorskip("public_tokenizers")
    own = packing._word_ids(P.path("word_bpe_49k.json")).tokenizer
    counted = CountedTokenizer(own)
    w = packing.WordIds(counted)
    texts = ["caf\u00e9, ni\u00f1%%% \u00c9! o\u00f9?! x., \u00df...", "\u03b1\u03b2\u03b3, \u0130. e\u0301, \u01f0! <|x|>. \u00c9;", "<|endoftext|>. \u00c9t\u00e9... \u00ef\u00ff*", "...", "\u00e9\u00e9\u00e9's, \u00e9'll."]
    for t in texts:
        assert np.frombuffer(w.ids([t.encode()])[0], "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, t
    # letters and marks by themselves: not as one word through the whole tokenizer
    assert not {"caf\u00e9,", "ni\u00f1%%%", "o\u00f9?!", "\u00df..."} & set(counted.calls)


def test_packed_pieces(spark):
    P = pytest.importorskip("public_tokenizers")
    d = docs(spark, [None, "", "a", "word " * 5000, "a"])
    got = packing.pack(packing.tokenize(d, P.path("word_bpe_49k.json"), with_ids=True)).collect()
    assert Counter(r["doc_id"] for r in got) == {0: 1, 1: 1, 2: 1, 3: 3, 4: 1}
    assert all(len(r["ids"]) == r["length"] for r in got)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_pipeline_packs_the_tokens(spark):
    import corpus_pipeline

    P = pytest.importorskip("public_tokenizers")
    texts = ["word " * 2100, "a b c", "", "no more, no less"]
    w, seqs, texts_back = packing._word_ids(P.path("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    for r in sorted(corpus_pipeline.pack_sequences(spark, docs(spark, texts), "").collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == len(seqs[r["sequence_id"]]) and r["length"] == len(r["ids"])
        seqs[r["sequence_id"]] += r["ids"]
        texts_back[r["doc_id"]].append((r["start"], r["ids"]))
    assert max(map(len, seqs.values())) == packing.LIMIT
    for d, t in enumerate(texts):
        assert list(chain.from_iterable(ids for _, ids in sorted(texts_back[d]))) == [*w.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID]


def test_pipeline_keeps_unlabelled_documents_with_a_letter(spark):
    import corpus_pipeline

    texts = ["plain words here", "тоже слова", None, "", "12 !?", "x1"]
    for langs in (None, ["und"] * len(texts)):
        assert sorted(r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, docs(spark, texts, langs=langs), "").collect()) == [0, 1, 5]


def test_op4_digests_come_from_the_packed_ids(spark, monkeypatch, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from lumenfuse.llm import queries

    docs(spark, ["a b c", None, "word " * 2100]).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: sorted(map(tuple, queries.op4_best_fit_packing(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert run() == sorted(map(tuple, packing.tokenize(spark.read.parquet(f"{tmp_path}/documents.parquet"), P.path("word_bpe_49k.json")).collect()))
    real = packing.pack
    monkeypatch.setattr(packing, "pack", lambda pieces: real(pieces).withColumn("ids", F.array(F.lit(7))))
    assert {(n, crc) for _, _, _, n, crc in run()} == {(1, zlib.crc32(bytes([7, 0, 0, 0])))}


def vectors(spark, x, labels):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], l) for i, (v, l) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int")


def some_vectors(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dim))
    x = list((base[rng.integers(0, len(base), n)] + 0.08 * rng.standard_normal((n, dim))).astype(np.float32))
    x[5] = x[10] = x[15] = x[400 // 3]
    return [*x, None, np.zeros(dim), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0]], rng.integers(0, 3, n).tolist() + [0] * 6


def test_embedding_dedup(spark):
    x, labels = some_vectors()
    labels[7] = None
    ok = [i for i in range(400) if labels[i] is not None]
    u = {i: np.array(x[i], float) / np.linalg.norm(np.array(x[i], float)) for i in ok}
    pairs = [(i, j) for i in ok for j in ok if j < i and labels[i] == labels[j] and float(u[i] @ u[j]) >= 0.98]
    n = Counter(chain.from_iterable(pairs))
    root = union_find(len(x), pairs)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(vectors(spark, x, labels)).collect()}
    assert pairs and len(got) == len(x)
    found = sum(r["n_links"] for r in got.values())
    assert found == sum(n.values()) and all(got[i]["n_links"] == n[i] for i in got)
    assert [got[i]["component_id"] for i in range(len(x))] == root
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embed_dedup.near_duplicates(vectors(spark, x, labels).limit(0)).count() == 0


def pairs_at(n, cosine, dim=64, seed=5):
    """n pairs of just this cosine, far from each other; a pair's rows are i and n + i."""
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return [*a, *(cosine * a + math.sqrt(1 - cosine**2) * b)]


def test_embedding_dedup_keeps_links_with_several_anchors(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL", 300)  # 6,000 vectors: 5 anchors
    assert embed_dedup.plan(6000, 0.98)[0] == 5
    got = embed_dedup.near_duplicates(vectors(spark, pairs_at(3000, 0.98001), [0] * 6000)).collect()
    assert sum(r["n_links"] for r in got) == 6000
    assert all(r["component_id"] == r["vec_id"] % 3000 for r in got)


def test_embedding_dedup_tasks_of_a_large_cluster_are_bounded(spark, monkeypatch):
    from pyspark.sql import GroupedData

    real, rows = GroupedData.applyInArrow, []

    def spied(self, func, schema):
        rows.append(max(r[0] for r in real(self, lambda t: pa.table({"n": [t.num_rows]}), "n long").collect()))
        return real(self, func, schema)

    monkeypatch.setattr(GroupedData, "applyInArrow", spied)
    monkeypatch.setattr(embed_dedup, "CELL", 100)
    monkeypatch.setattr(embed_dedup, "PART", 100)
    x = 1 + 1e-4 * np.random.default_rng(0).standard_normal((1000, 16))  # all near each other, none equal
    got = embed_dedup.near_duplicates(vectors(spark, x, [0] * 1000)).collect()
    assert all(r["n_links"] == 999 and r["component_id"] == 0 for r in got)
    assert max(rows) <= 2 * 2 * 100  # parts dealt by a hash: twice the mean at most


def test_embedding_dedup_recall_is_that_of_sets_and_count_together():
    p, same = embed_dedup.collision(0.98), embed_dedup.same_interval(math.sqrt(0.04))
    assert same == pytest.approx(np.clip(1 - np.abs(0.2 * np.random.default_rng(0).standard_normal(1_000_000)) / embed_dedup.WIDTH, 0, 1).mean(), abs=1e-3)
    before = 0
    for largest in (10, 6_000, 20_000, 50_000, 200_000, 400_000, 10_000_000, 10**9):
        anchors, sets, need = embed_dedup.plan(largest, 0.98)
        fewer = sum(math.comb(24, c) * p**c * (1 - p) ** (24 - c) for c in range(need))
        assert (1 - same**anchors) ** sets * (anchors > 0) + fewer <= 1e-4
        assert largest * embed_dedup.same_interval(math.sqrt(2)) ** anchors <= embed_dedup.CELL and anchors >= before
        before = anchors


def test_embedding_dedup_null_and_repeated_ids(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(None, a, 1, "x"), (4, a, 1, "y"), (4, a, 1, "y"), (2, b, 1, "z"), (2, a, 2, "z"), (9, b, 1, "w"), (7, a, 2, "v")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row string")
    got = sorted(map(tuple, embed_dedup.near_duplicates(d).collect()), key=str)
    assert got == sorted([(None, 0, None, None), (4, 1, 4, True), (4, 1, 4, True), (2, 1, 2, True), (2, 1, 2, True), (9, 1, 2, False), (7, 1, 2, False)], key=str)


def test_nearest_neighbours(spark):
    x, labels = some_vectors(seed=1)
    got = defaultdict(list)
    for r in ann_hilbert.nearest(vectors(spark, x, labels), F.col("vec_id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    ok = list(range(400))
    for q in range(0, 400, 20):
        want = sorted((math.sqrt(((np.array(x[q], float) - np.array(x[j], float)) ** 2).sum()), j) for j in ok if j != q)[:10]
        assert [v for _, v in got[q]] == [v for _, v in want]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want], rtol=1e-12)
    assert ann_hilbert.nearest(vectors(spark, x, labels).limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_neighbours_search_a_share_of_the_table(spark, monkeypatch):
    n, dim = 4000, 32
    x = np.random.default_rng(3).standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    real, pairs = ann_hilbert._distances, []

    def counted(asked, points, queries):
        out = real(asked, points, queries)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(ann_hilbert, "_distances", counted)
    got = defaultdict(set)
    for r in ann_hilbert.nearest(vectors(spark, list(x.astype(np.float32)), [0] * n), F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in range(0, n, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 10 * n / 100
    assert sum(pairs) <= 0.3 * n * n / 100  # exact distances: less than 0.3 of a full scan


def test_nearest_neighbours_ties_nulls_and_few(spark):
    a, b = [1.0, 2.0], [2.0, 1.0]
    rows = [(20, a, "p"), (20, a, "p"), (3, a, "q"), (5, a, "q"), (4, b, "q"), (None, a, "q"), (0, b, "q"), (40, [1.0, 2.0, 3.0], "q"), (60, None, "q")]
    got = sorted(tuple(r) for r in ann_hilbert.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), F.col("vec_id") % 20 == 0, 3).collect())
    far = math.sqrt(2)
    assert got == [(0, 1, 4, 0.0), (0, 2, 3, far), (0, 3, 5, far), (20, 1, 3, 0.0), (20, 2, 5, 0.0), (20, 3, 0, far)]


def test_hilbert_steps_are_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(hilbert_index(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_language_id(spark):
    rnd = random.Random(0)
    make = lambda parts: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(40))
    langs = {"aa": ["the", "ing", "ed", "on"], "bb": ["der", "sch", "ein", "üß"], "cc": ["qué", "ción", "los", "ña"]}
    rows = [(make(p), k) for k, p in langs.items() for _ in range(30)]
    profiles = language_id.learn_profiles(spark.createDataFrame(rows, "text string, lang string"))
    test = [(make(p), k) for k, p in langs.items() for _ in range(10)] + [(None, "und"), ("", "und"), ("123 !?", "und")]
    got = language_id.identify(docs(spark, [t for t, _ in test]), profiles).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == [k for _, k in test]
    assert all(0 <= r["score"] <= 1 for r in got) and got[-1]["score"] == 0
    assert [r["lang_pred"] for r in language_id.identify(docs(spark, ["abc"]), []).collect()] == ["und"]


def test_url_filter(spark):
    schema = "key string, listed_at date, action string"
    entries = spark.createDataFrame([("bad.com", "2024-01-10", "block"), ("bad.com", "2024-02-10", "drop"), ("x.bad.com/ok", "2024-01-15", "allow"), ("tie.com", "2024-01-01", "allow"), ("tie.com", "2024-01-01", "block"), (None, "2024-01-01", "block")], "key string, d string, action string").select("key", F.to_date("d").alias("listed_at"), "action")
    assert entries.schema.simpleString() == T._parse_datatype_string(schema).simpleString()
    cases = [("http://www.BAD.com/a", "2024-01-09", "keep"), ("http://bad.com/a", "2024-01-10", "block"), ("https://u:p@x.bad.com:8080/a?q", "2024-01-20", "block"), ("http://x.bad.com/ok/p", "2024-01-20", "allow"), ("http://x.bad.com/ok/p", "2024-01-14", "block"),
             ("http://bad.com", "2024-02-10", "keep"), ("http://notbad.com", "2024-01-20", "keep"), ("http://tie.com", "2024-03-01", "block"), (None, "2024-01-20", "keep"), ("nonsense", "2024-01-20", "keep"), ("http://bad.com/a", None, "keep")]
    d = spark.createDataFrame([(i, u, t, "x") for i, (u, t, _) in enumerate(cases)], "page_id long, url string, t string, key string").withColumn("fetched_at", F.to_date("t"))
    got = url_filter.filter_urls(d, entries).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == [v for _, _, v in cases]
    assert url_filter.filter_urls(d.limit(0), entries).count() == 0


CLASH = ["n_lines_removed", "lang_pred", "score", "verdict", "rule", "_size", "_nth", "_copy", "_pos", "row", "copies", "doc", "stays", "keeper", "spans", "k1", "h1", "t1"]


def mixed(texts, ids, sources):
    """How often each row is taken, by one queue."""
    sizes = [len(WORD.findall(t or "")) for t in texts]
    total = Counter()
    for s, n in zip(sources, sizes):
        total[s] += n
    goal = mixing.targets(list(total.items()))
    ran, queue = Counter(), []
    for i in sorted(range(len(texts)), key=lambda i: (hashlib.md5(str(ids[i]).encode()).hexdigest(), ids[i])):
        s = sources[i]
        ran[s] += sizes[i]
        if sizes[i] and goal[s]:
            queue += [((ran[s] + e * total[s]) / goal[s], s is None, s or "", hashlib.md5(str(ids[i]).encode()).hexdigest(), e, i) for e in range(2)]
    spent, taken = 0, Counter()
    for *_, i in sorted(queue):
        spent += sizes[i]
        if spent <= sum(goal.values()):
            taken[i] += 1
    return taken


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(5)
    texts = copies(9)
    texts = [t and t.replace(" a", "\nall rights reserved\na", 1) for t in texts]
    sources = [f"s{rnd.randrange(12)}" for _ in texts]
    texts[0] = "123 456"
    frame = docs(spark, texts, sources, langs=["aa" if t else None for t in texts]).withColumns({c: F.lit(9.5) for c in CLASH})
    ids = list(range(len(texts)))

    def rows(df):
        got = df.collect()
        assert df.columns == frame.columns and all(r[c] == 9.5 for r in got for c in CLASH)
        return sorted((r["doc_id"], r["text"], r["source"]) for r in got)

    assert rows(P.keep_known_languages(spark, frame, "")) == sorted((i, t, s) for i, t, s in zip(ids, texts, sources) if t and re.search("[a-z]", t))
    sites, keeper = defaultdict(set), {}
    for i, (t, s) in enumerate(zip(texts, sources)):
        for x in (t or "").split("\n"):
            sites[x].add(s)
            keeper.setdefault(x, i)
    bad = {x for x, s in sites.items() if len(s) >= 8 and len(x.split()) >= 2}
    assert bad == {"all rights reserved"}

    def cut(i, t):
        parts = t.split("\n")
        return "\n".join(x for k, x in enumerate(parts) if x not in bad or (keeper[x] == i and parts.index(x) == k))

    key = lambda r: (r[0], r[1] or "", r[2])
    got = sorted(((r["doc_id"], r["text"], r["source"]) for r in P.drop_boilerplate_lines(spark, frame, "").collect()), key=key)
    assert got == sorted(((i, None if t is None else cut(i, t), s) for i, t, s in zip(ids, texts, sources)), key=key)
    groups = {r["component_id"] for r in ngram_join.jaccard_components(frame).collect()}
    got = P.keep_one_of_each_group(spark, frame, "")
    assert got.columns == frame.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(groups)
    want = mixed(texts, ids, sources)
    got = P.mix_sources(spark, frame, "")
    assert got.columns == frame.columns and Counter(r["doc_id"] for r in got.collect()) == want


def test_pipeline_runs_whole_and_empty(spark, tmp_path):
    import corpus_pipeline as P

    texts = copies(9)
    d = docs(spark, texts, [f"s{i % 5}" for i in range(len(texts))], langs=["aa" if t else None for t in texts])
    for name, frame in (("some", d), ("none", d.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = P.run(spark, f"{tmp_path}/{name}").collect()
        load = Counter()
        for r in out:
            load[r["sequence_id"]] += r["length"]
        assert bool(out) == (name == "some") and max(load.values(), default=0) <= 2048


def test_pipeline_rejects_what_is_not_in_its_language(spark):
    import corpus_pipeline as P

    rnd = random.Random(0)
    make = lambda parts: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(40))
    langs = {"aa": ["the", "ing", "ed", "on"], "bb": ["der", "sch", "ein"]}
    rows = [(make(p), k) for k, p in langs.items() for _ in range(30)] + [(make(langs["aa"]), "bb"), (make(langs["bb"]), None)]
    d = docs(spark, [t for t, _ in rows], langs=[k for _, k in rows])
    assert sorted(r["doc_id"] for r in P.keep_known_languages(spark, d, "").collect()) == [*range(60), 61]
    assert {r["lang"] for r in P.keep_known_languages(spark, d, "", wanted=("aa",)).collect()} == {"aa"}


def test_intermediate_tables_are_deleted(spark):
    import os

    with common.scratch(spark):
        d = common.materialize(spark.range(3))
        path = d.inputFiles()[0].removeprefix("file://")
        assert d.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_language_distance_is_out_of_place_by_definition(spark):
    def ranked(text):
        line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        grams = Counter(line[i : i + k] for k in (1, 2, 3) for i in range(len(line) - k + 1))
        for g in [g for g in grams if g == " " or (len(g) == 3 and g[1] == " ")]:
            del grams[g]
        return sorted(grams, key=lambda g: (-grams[g], len(g), g))

    texts = [t for t in copies(4) if t and t.strip()] + ["Ñandú, ¿qué? 12 AbC", "a", "über ß ﬁ"]
    langs = ["aa", "bb", None] * len(texts)
    profiles = {}
    for lang in ("aa", "bb"):
        mine, counts = [t for t, k in zip(texts, langs) if k == lang], Counter()
        for t in mine:
            line = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
            counts.update(g for k in (1, 2, 3) for g in (line[i : i + k] for i in range(len(line) - k + 1)) if g != " " and not (len(g) == 3 and g[1] == " "))
        profiles[lang] = sorted(counts, key=lambda g: (-counts[g], len(g), g))[:300]
    learned = language_id.learn_profiles(spark.createDataFrame(list(zip(texts, langs)), "text string, lang string"))
    assert [(k, len(g)) for k, g in learned] == [(k, len(g)) for k, g in sorted(profiles.items())]
    for r in language_id.identify(docs(spark, texts), learned).collect():
        own = ranked(texts[r["doc_id"]])[:300]
        away = {k: sum(abs(g.index(x) - i) if x in g else 300 for i, x in enumerate(own)) for k, g in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert (r["lang_pred"], r["score"]) == (best, pytest.approx(1 - away[best] / (300 * len(own))))


def test_language_id_nulls_and_clashes(spark):
    d = spark.createDataFrame([(None, "abc abc", "x"), (1, None, "x"), (1, None, "x")], "doc_id long, text string, score string")
    with pytest.raises(ValueError):
        language_id.identify(d, [])
    assert [r["s"] for r in language_id.identify(d, [("k", [97])], names=("l", "s")).orderBy("doc_id").collect()][1:] == [0.0, 0.0]
    assert language_id.identify(d.drop("score").limit(0), []).count() == 0


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(1)
    texts = [np.minimum(rng.lognormal(m, d, 20_000).astype(int) + 1, 2047) for m, d in ((5, 1.2), (6.3, 0.8))]
    for lengths, most in (*((x, 1.0) for x in texts), (rng.integers(300, 1500, 5000), 1.01)):
        _, _, count = packing.best_two_fit(lengths.astype(np.int64), 2048)
        # first fit decreasing, and what no packing can go below
        room = np.zeros(0, int)
        for x in np.sort(lengths)[::-1]:
            at = int(np.argmax(room >= x)) if len(room) else 0
            if len(room) and room[at] >= x:
                room[at] -= x
            else:
                room = np.append(room, 2048 - x)
        plain, least = len(room), max(-(-lengths.sum() // 2048), (lengths > 1024).sum())
        assert least <= count <= most * plain, (count, plain, least)


def test_packing_null_and_repeated_ids(spark):
    P = pytest.importorskip("public_tokenizers")
    d = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1), (3, None, 2), (3, "", 2)], "doc_id long, text string, length long")
    got = packing.pack(packing.tokenize(d, P.path("word_bpe_49k.json"))).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == Counter({(None, 3): 2, (3, 1): 2})
    assert sorted(r["offset"] for r in got) == [0, 3, 6, 7] or len({(r["sequence_id"], r["offset"]) for r in got}) == 4
    assert packing.pack(packing.tokenize(d.limit(0), P.path("word_bpe_49k.json"))).count() == 0


def test_mixing_null_repeated_and_tied(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EDGE_ROWS", 5)
    rows = [(None, "a b c", "s", 1)] * 40 + [(7, "a b", "s", 2), (7, "c d", "s", 3), (7, "c d", "s", 3)] * 10 + [(i, "w " * (i % 9), None, 4) for i in range(60)] + [(5, None, "t", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long")
    plan = mixing.mix(d).collect()
    assert len(plan) == len(rows)
    by = defaultdict(int)
    for r in plan:
        by[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    goal = {r["source"]: r["target"] for r in plan}
    assert all(abs(by[s] - goal[s]) <= 16 for s in goal)
    got = mixing.mixed_documents(d)
    assert got.columns == d.columns and got.count() == sum(r["copies"] for r in plan)
    assert mixing.mixed_documents(d.limit(0)).count() == 0


def test_lines_null_ids_and_repeated_rows(spark):
    line = "all rights reserved"
    rows = [(None, f"{line}\nx {i}", f"s{i}", "own") for i in range(6)] + [(5, f"a b\n{line}", f"t{i}", "own") for i in range(3)] + [(5, None, "u", "own"), (6, "", None, "own")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, keeper string")
    got = Counter((r["doc_id"], r["text"], r["n_lines_removed"], r["keeper"]) for r in line_dedup.dedup_lines(d).collect())
    # a null id comes first and keeps the line, in each row where it stands in the same place
    assert got == Counter({**{(None, f"{line}\nx {i}", 0, "own"): 1 for i in range(6)}, (5, "a b", 1, "own"): 3, (5, None, 0, "own"): 1, (6, "", 0, "own"): 1})
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(d.withColumn("n_lines_removed", F.lit(1)))


def test_url_filter_deep_entries(spark):
    entries = spark.createDataFrame([("x.com/a/b/c/d/e", "2024-01-01", "block")], "key string, d string, action string").select("key", F.to_date("d").alias("listed_at"), "action")
    d = spark.createDataFrame([(1, "http://x.com/a/b/c/d/e/f?q"), (1, "http://x.com/a/b/c/d/e/f?q"), (2, "http://x.com/a/b/c/d"), (None, "http://x.com/a/b/c/d/e")], "page_id long, url string").withColumn("fetched_at", F.to_date(F.lit("2024-02-01")))
    assert sorted(((r["page_id"], r["verdict"]) for r in url_filter.filter_urls(d, entries).collect()), key=str) == [(1, "block"), (1, "block"), (2, "keep"), (None, "block")]
    assert {r["verdict"] for r in url_filter.filter_urls(d, entries.limit(0)).collect()} == {"keep"}


def test_chats_null_tied_and_empty(spark):
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, "user", "c"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_chats(chat_format.format_chats(d)).collect()}
    assert [t["text"] for t in got[None]["turns"]] == ["c", "a", "b"] and got[1]["loss_text"] == "xx"
    assert chat_format.read_chats(chat_format.format_chats(d.limit(0))).count() == 0


def test_a_language_of_copies_keeps_its_profile(spark):
    texts = [f"der hund und die katze sind im haus nummer {'n' * k}" for k in range(3)]
    for german in texts:  # one text, far more often than rows are learned from
        rows = [("der hund und die katze" if german is None else german, "de")] * 400 + [(f"the dog and the cat are in house {i} of the town", "en") for i in range(60)]
        names = [k for k, _ in language_id.learn_profiles(spark.createDataFrame(rows, "text string, lang string"), train_docs=20)]
        assert names == ["de", "en"]


def test_the_pipeline_keeps_languages_of_copies(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    german = "der hund und die katze sind in dem alten haus an der strasse und schlafen"
    d = docs(spark, [german] * 6000 + [f"the dog and the cat number {i} are in the old house of the town" for i in range(50)] + ["the cat is here again", "123"], langs=["de"] * 6000 + ["en"] * 50 + [None, "xx"])
    kept = corpus_pipeline.keep_known_languages(spark, d, "")
    assert kept.groupBy("lang").count().collect() and {r["lang"]: r["count"] for r in kept.groupBy("lang").count().collect()} == {"de": 6000, "en": 50, None: 1}


def plain_best_two_fit(lengths, limit):
    """Best-two-fit written out: every pair is tried; bins as sorted lists of lengths."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        held, gap = [], limit
        for x in list(left):
            if x <= gap:
                held.append(x)
                left.remove(x)
                gap -= x
        if gap and len(held) > 1:
            small = held[-1]
            best = max(((a + b, -min(a, b), a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= gap + small), default=None)
            if best and best[0] > small:
                held.pop()
                for x in best[2:]:
                    held.append(x)
                    left.remove(x)
                left = sorted([*left, small], reverse=True)
        bins.append(sorted(held))
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_equals_the_plain_version(seed):
    rnd = random.Random(seed)
    lengths = np.array([rnd.randint(1, 60) if seed % 2 else rnd.choice([7, 13, 22, 31, 45, 60]) for _ in range(150)])
    bins, offsets, n = packing.best_two_fit(lengths, 60)
    got = [sorted(lengths[bins == b].tolist()) for b in range(n)]
    assert got == plain_best_two_fit(lengths.tolist(), 60)


def test_packing_goes_by_bytes(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    texts = ["some words of a text " * n for n in (1, 400, 3, 0, 900)] + [None]
    want = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packing.tokenize(docs(spark, texts), path).collect())
    monkeypatch.setattr(packing, "BATCH_BYTES", 500)
    monkeypatch.setattr(packing, "BATCH_ROWS", 2)
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packing.tokenize(docs(spark, texts), path).collect()) == want
    assert list(packing._batches(pa.array([b"x" * 300, None, b"x" * 300, b"x" * 5000, b""]))) == [(0, 2), (2, 3), (3, 4), (4, 5)]
