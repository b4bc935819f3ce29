"""Line dedup by distinct-site spread: lines that many sites carry are boilerplate.

HyperLogLog sketches per line hash are merged by aggregation (map-side first, so a line of a third of the rows
costs one sketch a task).  Lines whose estimate is near the threshold get an exact count of distinct sites;
those clearly above or below do not need one.  Only lines that occur at least ``min_sites`` times are
sketched at all, as fewer occurrences cannot reach the threshold.  A line's first occurrence (smallest
doc_id, then place) stays, so no content is lost from the corpus as a whole.

Lines are hashed once: a table of one row a line (its place, its site and 128 bits of its hash) is written, and every later
step reads it.  Rows are known by doc_id and a 128-bit hash of the text, so rows without an id, or with the same, keep lists of
their own; rows that are equal in both have the same list.

DataFrame functions only.  Edge cases: null text stays null, empty text stays empty; blank lines and lines
of fewer than ``min_words`` words are never removed; null sites count as no site; a null doc_id sorts first
as a keeper; repeated rows keep the line in each row of the first document; an empty table gives an
empty one; a text of very many lines is one list of places.  All other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfuse.llm.common import checked_broadcast, materialize

MIN_SITES, MIN_WORDS, LG_K, BAND = 8, 2, 12, 0.1


def hashed_lines(documents: DataFrame, site: str = "source", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t1, t2, pos, site, h1, h2) of each line of at least min_words words; written."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), F.col(f"`{site}`").cast("string").alias("site"), "text")
    lines = rows.select("doc_id", "t1", "t2", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.size(F.split(F.trim("line"), " +")) >= min_words)
    return materialize(lines.select("doc_id", "t1", "t2", "pos", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, keeper): the ``hashed_lines`` on at least min_sites sites, and the doc_id that keeps each; written."""
    # one pass: how often, and who comes first
    often = materialize(lines.groupBy("h1", "h2").agg(F.count("site").alias("k"), F.min(F.struct("doc_id")).alias("first")).where(F.col("k") >= min_sites))
    named = lines.select("h1", "h2", "site").where(F.col("site").isNotNull())
    spread = named.join(checked_broadcast(often.select("h1", "h2")), ["h1", "h2"], "left_semi")
    spread = materialize(spread.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about")).where(F.col("about") >= min_sites * (1 - BAND)))
    near = spread.where(F.col("about") <= min_sites * (1 + BAND)).select("h1", "h2")
    exact = named.join(checked_broadcast(materialize(near)), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites)
    sure = spread.where(F.col("about") > min_sites * (1 + BAND)).select("h1", "h2").union(exact.select("h1", "h2"))
    return materialize(sure.join(often, ["h1", "h2"]).select("h1", "h2", F.col("first.doc_id").alias("keeper")))


def dedup_lines(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, counted: str | None = "n_lines_removed") -> DataFrame:
    """``documents`` with boilerplate lines taken out of ``text``, plus their number as ``counted`` (None: not added); rows and other columns stay.

    A column of the name ``counted`` must not be there yet.
    """
    if counted and counted.lower() in (c.lower() for c in documents.columns):
        raise ValueError(f"there is a column {counted!r} already")
    lines = hashed_lines(documents, site, min_words)
    bad = boilerplate_lines(lines, min_sites)
    at = lines.select("doc_id", "t1", "t2", "pos", "h1", "h2").join(checked_broadcast(bad), ["h1", "h2"])
    # The keeper's own first place of the line is kept, its later ones go.
    firsts = at.where(F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("h1", "h2").agg(F.min("pos").alias("keep"))
    at = at.join(checked_broadcast(materialize(firsts)), ["h1", "h2"], "left").where(~(F.col("doc_id").eqNullSafe(F.col("keeper")) & (F.col("pos") == F.col("keep"))))
    # no limit on sites: a document's list of places is at most its own number of lines
    gone = materialize(at.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    text, listed = F.col("d.text"), F.col("g.gone")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(text) == F.col("g.t1")) & (F.xxhash64(F.lit(7), text) == F.col("g.t2"))
    joined = documents.alias("d").join(gone.alias("g"), same, "left")  # grows with the documents: the same join at every size
    parts = F.split(text, "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains(listed, i))
    new = F.when(text.isNotNull(), F.when(listed.isNull(), text).otherwise(F.array_join(kept, "\n")))
    removed = F.when(listed.isNull() | text.isNull(), 0).otherwise(F.size(listed)).cast("long")
    return joined.select(*[new.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in documents.columns], *([removed.alias(counted)] if counted else []))
