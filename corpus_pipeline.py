"""A corpus from raw documents to packed sequences: five stages, each of which reads what its predecessor wrote.

Columns of the documents keep their names and values whatever they are called; what a stage needs besides stays inside it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfuse.llm import language_id, line_dedup, mixing, ngram_join, packing
from lumenfuse.llm.common import checked_broadcast, fresh_name, materialize, remove_folder, scratch, shared_dir

#: Packing and profiles cannot be expressed in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None
#: Languages that stay, of those that profiles were learned for; None: all of them.
WANTED: tuple[str, ...] | None = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: tuple[str, ...] | None = WANTED) -> DataFrame:
    """Documents stay whose text is nearest to the profile of the language they are labelled with, or that have no label, if that language is wanted.

    Texts without a letter, which no profile can name, go.  Where a label has no profile (or no row has a language at all), documents with a letter stay.
    """
    profiles = language_id.learn_profiles(docs.select("text", "lang"))
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred = fresh_name("lang_pred", docs.columns)
    score = fresh_name("lang_score", [*docs.columns, pred])
    named = language_id.identify(docs, profiles, names=(pred, score))
    label = F.coalesce(F.nullif(F.col("lang").cast("string"), F.lit(language_id.UNKNOWN)), F.col(pred))
    known = label.isin(*[name for name, _ in profiles])
    stays = F.col("text").rlike(r"\p{L}") & ((F.col(pred) == label) | ~known)
    stays = stays if wanted is None else stays & F.col(pred).isin(*wanted)
    return named.where(stays).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sources stay in their first document only; every document stays."""
    return line_dedup.dedup_lines(docs, counted=None)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document of the smallest id stays; rows with a null id stay, rows that repeat whole texts under one id do so once."""
    groups = ngram_join.jaccard_components(docs)
    ids = materialize(groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")))
    stays = fresh_name("stays", docs.columns)
    once, more = (ids.where(c).select(F.col("doc_id").alias(stays)) for c in ("rows = 1", "rows > 1"))
    once, more = once.hint("merge"), checked_broadcast(more)  # the first grows with the documents: the same join at every size
    same = docs["doc_id"].cast("long") == F.col(stays)
    twice = docs.join(more, same, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    nth = F.row_number().over(W.partitionBy("doc.doc_id", F.xxhash64("doc.text"), F.xxhash64(F.lit(7), "doc.text")).orderBy("doc"))
    twice = twice.withColumn("nth", nth).where("nth = 1").select("doc.*")
    return docs.join(once, same, "left_semi").union(twice).union(docs.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their place: a sequence is the ids of its pieces by offset."""
    import public_tokenizers

    return packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what is between them is written to the shared folder, and deleted when the next stage is written."""
    docs, top, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path := f"{top}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
