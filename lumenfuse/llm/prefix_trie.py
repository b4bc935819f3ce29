"""Conversation prefix trie: which conversations begin alike, and what storing shared turns once would save.

Method: level-synchronous construction.  Per depth, live conversations are grouped by (parent node, next turn); the smallest conv_id of a
group names the new node.  Then levels are joined in reverse order, and leaves and savings roll up from children to parents.

* A turn is known by the MD5 of its role and text (128 bits), so texts are read once and never shuffled.
* Conversations that are equal as a whole (two 64-bit hashes over their numbered turns, and their number) are one class with a weight,
  so a group of copies is one live row at any depth.
* A class that is alone in its node leaves the live set: its further nodes are a chain, which needs no grouping.  The loop thus ends where the last two
  different conversations part, not at the longest conversation.
* A group is found by an aggregate with map-side combine and joined back by a checked broadcast or a join that AQE can split, so a turn that very
  many conversations begin with is never gathered in one task.

Edge cases: null turns sort first, ties go by role and text; a null role or text is empty; rows with a null conv_id take no part; a conversation
without turns ends at the root; repeated rows are turns of their own; without conversations there is no node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfuse.llm.common import checked_broadcast, materialize
from lumenfuse.llm.digest import ordered_sha256


def turn_keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, chars): turns numbered from 1, each as a digest of role and text and the code points of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    pos = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    return rows.select("conv_id", pos.alias("pos"), key.alias("key"), F.length("text").cast("long").alias("chars"))


def _classes(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, cls, depth): cls is the smallest conv_id of the same whole sequence of turns, depth their number."""
    mark = [F.bit_xor(F.xxhash64(F.lit(seed), "pos", "key")).alias(f"m{seed}") for seed in (1, 2)]
    whole = ids.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key")).union(turns.select("conv_id", "pos", "key"))
    whole = whole.groupBy("conv_id").agg(*mark, F.max("pos").alias("depth"))
    whole = materialize(whole)
    first = whole.groupBy("m1", "m2", "depth").agg(F.min("conv_id").alias("cls"))
    return whole.join(first, ["m1", "m2", "depth"]).select("conv_id", "cls", "depth")


def build(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the trie.

    ``ids(conv_id)`` names the conversations, each once; ``turns(conv_id, pos, key, chars)`` are theirs, pos from 1 without gaps.  A node is known by its
    depth and its smallest member; saved_tokens counts code points.
    """
    classes = materialize(_classes(ids, turns))
    weights = materialize(classes.groupBy(F.col("cls").alias("conv_id"), F.col("depth").alias("last")).agg(F.count(F.lit(1)).alias("w")))
    # from here on a conversation stands for its class
    turns = materialize(turns.join(weights, "conv_id"))
    top = materialize(weights.agg(F.min("conv_id").alias("conv_id"), F.sum("w").alias("n_convs"), F.count(F.lit(1)).alias("n_classes")).where("conv_id is not null"))
    levels, ends = _down(weights, turns, top)
    heads = reduce(DataFrame.union, [level.where("n_classes = 1").select("conv_id", F.lit(d).alias("head")) for d, level in enumerate(levels)])
    chain = _chains(turns, materialize(heads))
    ends.append(heads.join(weights, "conv_id").select("conv_id", F.col("conv_id").alias("node"), F.col("last").alias("depth")))
    nodes = _up(levels, chain)
    place = reduce(DataFrame.union, ends).select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("cls"))
    ended = place.join(_end_digests(classes), "cls").drop("cls")
    return nodes.join(ended, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def _down(weights: DataFrame, turns: DataFrame, top: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes of each depth outside of chains, classes that end at a node of several: conv_id, node, depth)."""
    levels = [top.select("conv_id", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("chars"), "n_classes")]
    root = top.first()
    if root is None or root["n_classes"] == 1:
        return levels, []
    live, held, depth, ends = weights.select("conv_id", F.lit(root["conv_id"]).cast("long").alias("node"), "last"), root["n_classes"], 0, []
    while True:
        ends.append(live.where(F.col("last") == depth).select("conv_id", "node", F.lit(depth).alias("depth")))
        live = live.where(F.col("last") > depth)
        if not (now := live.count()):
            return levels, ends
        depth += 1
        if now < held / 2:  # go on with the turns of conversations that still live
            turns, held = materialize(turns.where(F.col("pos") >= depth).join(live.select("conv_id"), "conv_id", "left_semi")), now
        step = turns.where(F.col("pos") == depth).select("conv_id", "key", "chars", "w").join(live, "conv_id")
        group = step.groupBy("node", "key").agg(F.min("conv_id").alias("child"), F.sum("w").alias("n_convs"), F.max("chars").alias("chars"), F.count(F.lit(1)).alias("n_classes"))
        group = materialize(group)
        levels.append(group.select(F.col("child").alias("conv_id"), F.col("node").alias("parent"), "n_convs", "chars", "n_classes"))
        shared = checked_broadcast(group.where("n_classes > 1").select("node", "key", "child"))
        live = materialize(step.join(shared, ["node", "key"]).select("conv_id", F.col("child").alias("node"), "last"))


def _chains(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """(conv_id, pos, head, w, last, saved): the turns of classes from the node on in which they are alone; what they save from there down."""
    down = W.partitionBy("conv_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = turns.join(heads, "conv_id").where(F.col("pos") >= F.col("head"))
    return materialize(rows.select("conv_id", "pos", "head", "w", "last", F.sum((F.col("w") - 1) * F.col("chars")).over(down).alias("saved")))


def _up(levels: list[DataFrame], chain: DataFrame) -> DataFrame:
    """All nodes; leaves and savings of children are added up level by level, from the deepest to the root."""
    one = lambda c: F.lit(c).cast("long")
    chained = chain.where(F.col("pos") > F.col("head")).select(
        "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("w").alias("n_convs"),
        (F.col("pos") < F.col("last")).cast("long").alias("n_children"), one(1).alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    )
    # what a head, in which a class is alone, has under it; a root has no turn of its own
    at_head = chain.where("pos = head or (head = 0 and pos = 1)").select("conv_id", "head", "saved", (F.col("last") > F.col("head")).cast("long").alias("next"))
    nodes, below = [chained], None
    for d in range(len(levels) - 1, -1, -1):
        here = levels[d].join(at_head.where(F.col("head") == d).drop("head"), "conv_id", "left")
        if below is None:
            here = here.withColumns({k: one(None) for k in ("kids", "leaves", "under")})
        else:
            sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("under"))
            here = here.join(sums, "conv_id", "left")
        alone, none = F.col("n_classes") == 1, one(0)
        below = materialize(here.select(
            "conv_id", F.lit(d).alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
            F.when(alone, F.coalesce("next", none)).otherwise(F.coalesce("kids", none)).alias("n_children"),
            F.when(alone, one(1)).otherwise(F.coalesce("leaves", one(1))).alias("n_leaves"),
            F.when(alone, F.coalesce("saved", none)).otherwise((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("under", none)).alias("saved_tokens"),
        ))
        nodes.append(below)
    return reduce(DataFrame.union, nodes)


def _end_digests(classes: DataFrame) -> DataFrame:
    """(cls, ends_sha256): digest of the ids in each class, ascending; copies are streamed."""
    sizes = classes.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    single = sizes.where("n = 1").select("cls", F.sha2(F.col("cls").cast("string").cast("binary"), 256).alias("ends_sha256"))
    return single.union(ordered_sha256(classes.join(sizes.where("n > 1"), "cls"), "cls", "conv_id", F.col("conv_id").cast("string"), ",", "ends_sha256"))
