"""Structure repair and the prefix trie against brute-force versions, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenfuse.llm import conversation_repair, prefix_trie, queries

ROWS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def by_conversation(rows):
    out = defaultdict(list)
    for c, *r in rows:
        out[c].append(r)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def brute_repair(rows):
    """Every sequence of edits with up to two inserts in each gap, tried one by one."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.strip(WHITE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    best = None
    for edits in itertools.product(*[["D", "K", "R"]] * len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits)):
            continue
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            letters = "".join("I" * g + e for g, e in zip(gaps, edits)) + "I" * gaps[-1]
            cost = sum({"D": 4, "K": 0, "R": 3, "I": 3}[x] for x in letters) + sum(3 for f, e in zip(faults, edits) if f == "truncated" and e != "D")
            if best and (cost, letters) >= best[:2]:
                continue
            out, i = [], 0
            for x in letters:
                if x in "DKR":
                    role, text = rows[i][1:]
                    i += 1
                if x == "D":
                    continue
                given = "assistant" if out and out[-1][0][:1] == "u" else "user"
                out.append((role, text) if x == "K" else (given, text if x == "R" else ""))
            if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                best = (cost, letters, "\n".join(f"{r}:{t}" for r, t in out))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": best[0], "audit": best[1], "text": best[2]}


def told(spark, rows):
    report, turns = conversation_repair.repair(spark.createDataFrame(rows, ROWS))
    text = defaultdict(list)
    for r in turns.orderBy("place").collect():
        text[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    return {r["conv_id"]: {**{k: r[k] for k in r.asDict() if k != "conv_id"}, "text": "\n".join(text[r["conv_id"]])} for r in report.collect()}


def conversations(n, most, seed):
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            out.append((c, rnd.choice([t, t, t + rnd.randint(0, 2), None]), role, rnd.choice(["a.", "b?", "cut", " ", "", "d!\n", "a."])))
    return out


def test_repair_equals_brute_force(spark):
    rows = conversations(60, 4, 5)
    want = {c: brute_repair(r) for c, r in by_conversation(rows).items()}
    assert told(spark, rows) == want


def test_repair_in_small_batches_and_parts(spark, monkeypatch):
    rows = conversations(25, 30, 6)
    whole = told(spark, rows)
    monkeypatch.setattr(conversation_repair, "SEGMENT", 3)
    monkeypatch.setattr(conversation_repair, "BATCH_ROWS", 11)
    monkeypatch.setattr(conversation_repair, "EDIT_LETTERS", 4)
    assert told(spark, rows) == whole
    assert max(len(x["audit"]) for x in whole.values()) > 20


def test_repair_of_a_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(3000)] + [(2, 0, "assistant", "x.")]
    out = told(spark, rows)
    assert (out[1]["cost"], out[1]["audit"]) == (0, "K" * 3000)
    assert (out[2]["cost"], out[2]["audit"]) == (3, "IK")


def test_repair_edge_cases(spark):
    rows = [(None, 1, "user", "a."), (None, None, None, None), (5, 2, "user", "q."), (5, 2, "user", "q."), (6, None, "s", "x.")]
    out = told(spark, rows)
    assert out[None]["blank"] == 1 and out[None]["gaps"] == 0 and out[None]["audit"] == "DKI" and out[None]["text"] == "user:a.\nassistant:"
    assert (out[5]["duplicate"], out[5]["cost"], out[5]["audit"]) == (1, 7, "KDI")
    assert out[6]["audit"] == "D" and out[6]["text"] == ""
    extra = spark.createDataFrame([(1, 0, "user", "hi.", 3, "z")], ROWS + ", i int, fault string")
    assert conversation_repair.repair(extra)[0].first()["audit"] in ("KI",)
    assert conversation_repair.repair(spark.createDataFrame([], ROWS))[0].count() == 0


def test_damage_follows_the_crc(spark):
    rows = conversations(80, 4, 7) + [(None, 3, "user", "x.!?"), (1, 90, None, None)]
    want = []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit:
            row = (c, t, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
            want += [row] * (2 if hit == 3 else 1)
    got = [tuple(r) for r in queries.damaged(spark.createDataFrame(rows, ROWS)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def brute_trie(turns, ids):
    """Nodes of sequences: prefix to members."""
    nodes = defaultdict(list)
    for c in ids:
        for d in range(len(turns[c]) + 1):
            nodes[tuple(turns[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if len(turns[c]) == len(p)))) for p, m in nodes.items()}
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(ends[p])) for p, m in nodes.items())


def trie(spark, turns, ids):
    rows = [(c, i, role, text) for c in ids for i, (role, text) in enumerate(turns[c])]
    keys = prefix_trie.turn_keys(spark.createDataFrame(rows, ROWS))
    out = prefix_trie.build(spark.createDataFrame([(c,) for c in ids], "conv_id long"), keys)
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *list(r)[3:]) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("kind", ["mixed", "copies", "one", "turnless", "deep"])
def test_trie_equals_brute_force(spark, kind):
    rnd = random.Random(3)
    pick = lambda n: [(rnd.choice(["user", "a"]), rnd.choice(["x", "yy", ""])) for _ in range(n)]
    if kind == "mixed":
        turns = {7 * c + 3: pick(rnd.randint(0, 6)) for c in range(60)}
    elif kind == "copies":
        base = pick(12)
        turns = {c: base for c in range(40)} | {100 + c: base[: c % 12] + pick(2) for c in range(15)}
    elif kind == "one":
        turns = {4: pick(3)}
    elif kind == "turnless":
        turns = {4: [], 9: []}
    else:
        base = pick(9)
        turns = {1: [*base, ("u", "l")], 2: [*base, ("u", "r")], 3: base[:5], 5: base, 8: [("z", "z")]}
    assert trie(spark, turns, sorted(turns)) == brute_trie(turns, sorted(turns))


def test_trie_of_no_conversations(spark):
    keys = prefix_trie.turn_keys(spark.createDataFrame([(None, 1, "user", "x")], ROWS))
    assert keys.count() == 0
    assert prefix_trie.build(keys.select("conv_id"), keys).count() == 0


def test_rebuilt_conversations(spark):
    rnd = random.Random(9)
    rows = [(c, rnd.choice([None, t]) if t == 0 else t, rnd.choice(["user", None]), rnd.choice(["x", None, f"t{t}"])) for c in (*range(0, 40), *range(205, 215), 100, 300, 399, 450) for t in range(rnd.randint(1, 8))]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or "")
    own = {c: [(x[1] or "", x[2] or "") for x in sorted(v, key=order)] for c, v in by_raw(rows).items()}
    turns = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    ids, keys = queries.rebuilt(prefix_trie.turn_keys(spark.createDataFrame(rows, ROWS)))
    got = prefix_trie.build(ids, keys).select("conv_id", "depth", F.coalesce("parent_conv_id", F.lit(-1)), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(tuple(r) for r in got.collect()) == brute_trie(turns, sorted(turns))


def by_raw(rows):
    out = defaultdict(list)
    for c, *r in rows:
        out[c].append(r)
    return out
