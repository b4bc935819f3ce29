"""Conversation structure repair: the cheapest edits that give each conversation a well-formed sequence of roles.

A repaired conversation has role initials ``(s?(ua)+)?``: nothing, or an optional system turn and then user and assistant in
turn.  Rows are kept (0), given the role user or assistant (3), deleted (4; blank rows and repeats of an earlier row must be), and
empty turns of user or assistant may be inserted anywhere (3); a truncated row that stays adds 3.  Of the cheapest
sequences of edits the least one by ASCII is taken, as a string of initials D, I, K, R (the audit).

Method: rows are hash-partitioned by conversation and sorted; a task takes them in batches of bounded size, and a
recursive DuckDB query advances one turn in all conversations of the batch at a time, keeping the least (cost, audit) for each state of the
grammar.  Two audits of one cost that end in one state after one row are never prefixes of each other, so the least of them stays
the least whatever follows.  A conversation that is longer than a batch allows enters the next batch with its
states; what all its states agree on is set aside, so the recursion always works on short strings.

Edge cases: a null text or role counts as one blank (blank text; a role outside the grammar); null turns sort first, ties go by
role and text; repeated rows are duplicates; a null conv_id is one conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfuse.llm.common import lean, materialize

COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
#: Rows in a batch, rows of one conversation in it, and letters in a row of edits.
BATCH_ROWS, SEGMENT, EDIT_LETTERS = 20_000, 256, 1_000

_WORD_CHAR = r"[^\x20\x09-\x0D]"


def faults(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, turn, role, text, initial, fault): rows numbered from 1, each with its first fault or null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text")).repartition("conv_id")
    rows = rows.withColumn("i", F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy("i")))
    last = F.regexp_extract("text", rf"(?s)({_WORD_CHAR})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "i", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal) of ``faults``: missing turns, rows by fault, pairs of neighbours whose roles do not follow each other."""
    count = lambda c: F.sum(c.cast("long"))
    after = F.lead("initial").over(W.partitionBy("conv_id").orderBy("i"))
    pairs = rows.select("conv_id", "turn", "fault", (~F.concat("initial", after).isin("su", "ua", "au")).alias("wrong"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    # distinct turns are counted after a first sum per (conversation, turn), so a long conversation is spread
    turns = pairs.groupBy("conv_id", "turn").agg(*[count(F.coalesce(F.col("fault") == k, F.lit(False))).alias(k) for k in ("blank", "duplicate", "truncated")], count(F.coalesce("wrong", F.lit(False))).alias("illegal"))
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")])


# ---------------------------------------------------------------- the grammar

#: States of the grammar, by what has been put out: nothing, a system turn, or user or assistant last (after a system turn: with "s").
_NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "su"}, "u": {"a": "a"}, "a": {"u": "u"}, "su": {"a": "sa"}, "sa": {"u": "su"}}
_ENDS = ("", "a", "sa")


def _inserts(state: str) -> list[tuple[str, str]]:
    """(letters, state) of up to two inserted turns; more never pay."""
    out = [("", state)]
    for _ in range(2):
        letters, at = out[-1]
        out.append((letters + "I", next(t for x, t in _NEXT[at].items() if x != "s")))
    return out


def _moves() -> pa.Table:
    """Inserts, then one row's edit: (state, letters, cost, edit, initial, state after)."""
    rows = []
    for state in _NEXT:
        for letters, mid in _inserts(state):
            cost = COSTS["I"] * len(letters)
            rows.append((state, letters + "D", cost + COSTS["D"], "D", "", mid))
            for initial, after in _NEXT[mid].items():
                rows.append((state, letters + "K", cost + COSTS["K"], "K", initial, after))
                if initial != "s":
                    rows.append((state, letters + "R", cost + COSTS["R"], "R", "", after))
    return pa.table(dict(zip(("state", "letters", "cost", "edit", "initial", "after"), map(list, zip(*rows)))))


def _closing() -> pa.Table:
    """Inserts after the last row that end in a well-formed conversation."""
    rows = [(state, letters, COSTS["I"] * len(letters), end) for state in _NEXT for letters, end in _inserts(state) if end in _ENDS]
    return pa.table(dict(zip(("state", "letters", "cost", "ended"), map(list, zip(*rows)))))


_ADVANCE = f"""
create or replace temp table reached as
with recursive ends as (select s.g, coalesce(max(t.i), 0) as n from (select distinct g from starts) s left join turns t using (g) group by s.g),
path as (
  select g, 0 as i, state, {{'cost': cost, 'audit': audit}} as best from starts
  union all
  select p.g, p.i + 1, m.after, min({{'cost': p.best.cost + m.cost + case when t.truncated and m.edit <> 'D' then {TRUNCATED_COST} else 0 end, 'audit': p.best.audit || m.letters}})
  from path p join turns t on t.g = p.g and t.i = p.i + 1
    join moves m on m.state = p.state and (m.edit = 'D' or not t.must_go and (m.edit = 'R' or m.initial = t.initial))
  group by p.g, p.i, m.after)
select p.g, p.state, p.best.cost as cost, p.best.audit as audit from path p join ends e on e.g = p.g and e.n = p.i
"""
_CLOSE = """
select g, best.cost, best.audit, best.ended from (
  select r.g, min({'cost': r.cost + c.cost, 'audit': r.audit || c.letters, 'ended': c.ended}) as best from reached r join closing c using (state) group by r.g)
"""


class _Batch:
    """Conversations of one recursion: their rows, and the states in which they enter it."""

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.register("moves", _moves())
        self.db.register("closing", _closing())
        self.clear()

    def clear(self) -> None:
        self.keys: list = []
        self.settled: list[list[str]] = []
        self.starts: list[tuple] = []  # g, state, cost, audit
        self.turns: list[tuple] = []  # g, i, initial, must_go, truncated

    def open(self, key, settled: list[str] | None = None, states: list[tuple] | None = None) -> None:
        g = len(self.keys)
        self.keys.append(key)
        self.settled.append(settled or [])
        self.starts += [(g, *s) for s in states or [("", 0, "")]]
        self.n = 0

    def add(self, initial: str, must_go: bool, truncated: bool) -> None:
        self.n += 1
        self.turns.append((len(self.keys) - 1, self.n, initial, must_go, truncated))

    def full(self) -> bool:
        return self.n >= SEGMENT or len(self.turns) >= BATCH_ROWS

    def run(self, goes_on: bool) -> tuple[list[tuple], tuple | None]:
        """((key, cost, audit, last state) of each conversation but the last if it goes on; what the last one needs to go on)."""
        table = lambda rows, names, types: pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)
        self.db.register("starts", table(self.starts, ["g", "state", "cost", "audit"], [pa.int32(), pa.string(), pa.int64(), pa.string()]))
        self.db.register("turns", table(self.turns, ["g", "i", "initial", "must_go", "truncated"], [pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]))
        self.db.execute(_ADVANCE)
        last, rest = len(self.keys) - 1, None
        done = [(self.keys[g], cost, "".join(self.settled[g]) + audit, end) for g, cost, audit, end in self.db.execute(_CLOSE).fetchall() if not (goes_on and g == last)]
        if goes_on:
            states = self.db.execute("select state, cost, audit from reached where g = ?", [last]).fetchall()
            same = os.path.commonprefix([a for _, _, a in states])
            rest = (self.keys[last], [*self.settled[last], same], [(s, c, a[len(same) :]) for s, c, a in states])
        self.clear()
        return done, rest


def cheapest_edits(rows: DataFrame) -> DataFrame:
    """(conv_id, part, rows_before, outs_before, with_system, letters, cost) from ``faults``: the audit of each conversation in parts of at most EDIT_LETTERS.

    ``cost`` stands in the first part only, and is null in others.
    """
    names = ["conv_id", "part", "rows_before", "outs_before", "with_system", "letters", "cost"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]

    def parts(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, cost, audit, end in done:
            before, outs = 0, 0
            for k, at in enumerate(range(0, max(len(audit), 1), EDIT_LETTERS)):
                some = audit[at : at + EDIT_LETTERS]
                out.append((key, k, before, outs, end.startswith("s"), some, None if at else cost))
                before += len(some) - some.count("I")
                outs += len(some) - some.count("D")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, any_row = _Batch(), False
        for b in batches:
            for key, initial, must_go, truncated in zip(*(b.column(k).to_pylist() for k in range(4))):
                if batch.keys and batch.full():
                    done, rest = batch.run(goes_on=True)
                    yield from parts(done)
                    batch.open(*rest)
                if not any_row or key != batch.keys[-1]:
                    batch.open(key)
                    any_row = True
                batch.add(initial, must_go, truncated)
        if any_row:
            yield from parts(batch.run(goes_on=False)[0])

    kind = F.coalesce("fault", F.lit(""))
    sent = rows.select("conv_id", "i", "initial", kind.isin("blank", "duplicate").alias("must_go"), (kind == "truncated").alias("truncated"))
    ready = sent.repartition("conv_id").sortWithinPartitions("conv_id", "i").select("conv_id", "initial", "must_go", "truncated")
    return ready.mapInArrow(lean(run), "conv_id long, part int, rows_before long, outs_before long, with_system boolean, letters string, cost long")


def audits(edits: DataFrame) -> DataFrame:
    """(conv_id, cost, audit)."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "letters"))), lambda x: x["letters"]), "")
    return edits.groupBy("conv_id").agg(F.max("cost").alias("cost"), joined.alias("audit"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of the repaired conversations, numbered from 1."""
    upto = lambda without: F.length(F.replace(F.substr("letters", F.lit(1), F.col("k") + 1), F.lit(without), F.lit(""))).cast("long")
    each = edits.select("*", F.posexplode(F.split("letters", "")).alias("k", "edit")).where("edit not in ('D', '')")
    each = each.select("conv_id", "edit", "with_system", (F.col("outs_before") + upto("D")).alias("place"), F.when(F.col("edit") != "I", F.col("rows_before") + upto("I")).alias("row"))
    same = each["conv_id"].eqNullSafe(rows["conv_id"]) & (each["row"] == rows["i"])
    given: Column = F.when((each["place"] - each["with_system"].cast("int")) % 2 == 1, "user").otherwise("assistant")
    role = F.when(each["edit"] == "K", rows["role"]).otherwise(given)
    return each.join(rows, same, "left").select(each["conv_id"], "place", role.alias("role"), F.coalesce(rows["text"], F.lit("")).alias("text"), "edit")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; the repaired turns).

    Numbered rows and edits are written once; the rest is lazy.
    """
    rows = materialize(faults(conversations))
    edits = materialize(cheapest_edits(rows))
    told, cheapest = report(rows), audits(edits)
    both = told.join(cheapest.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    return both, repaired(rows, edits)
