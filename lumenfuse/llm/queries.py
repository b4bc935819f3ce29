"""The queries over the training-data tables: thin wrappers that derive digests from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfuse.llm import ann_hilbert, chat_format, conversation_repair, embed_dedup, language_id, line_dedup, mixing, ngram_join, packing, prefix_trie, substring_dedup, token_counts, url_filter
from lumenfuse.llm.common import materialize
from lumenfuse.llm.digest import ordered_sha256


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    back = chat_format.read_chats(chat_format.format_chats(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.tokenize(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    return packing.digests(packing.pack(pieces)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_hilbert.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: a fixed head, and entries that an MD5 of the host decides."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    part = lambda i: F.conv(F.substring(F.md5("host"), 1 + 7 * i, 7), 16, 10).cast("int")
    start = F.to_date(F.lit("2024-01-01"))
    h = hosts.select("host", part(0).alias("a"), part(1).alias("b"), part(2).alias("c"))
    block = h.where("a % 3 = 0").select(F.col("host").alias("key"), F.date_add(start, (F.col("b") % 200).cast("int")).alias("listed_at"), F.lit("block").alias("action"))
    drop = h.where("a % 3 = 0 and c % 2 = 0").select(F.col("host").alias("key"), F.date_add(start, (60 + F.col("b") % 200 + F.col("c") % 90).cast("int")).alias("listed_at"), F.lit("drop").alias("action"))
    allow = h.where("a % 5 = 0").select(F.concat("host", F.lit("/en")).alias("key"), F.date_add(start, (F.col("c") % 100).cast("int")).alias("listed_at"), F.lit("allow").alias("action"))
    head = pages.sparkSession.createDataFrame([("adult-x.example.com", "2024-01-01", "block"), ("example.org", "2024-06-01", "block"), ("example.org", "2024-09-01", "drop")], "key string, d string, action string")
    return block.union(drop).union(allow).union(head.select("key", F.to_date("d").alias("listed_at"), "action"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of ``pages``, fetched in 2024 on a day that the page_id gives."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id"), F.lit(366)).cast("int")))
    return url_filter.filter_urls(captures, url_list(pages)).select("page_id", "fetched_at", "verdict", "rule")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    profiles = language_id.learn_profiles(docs.where(~held).select("text", "lang"))
    return language_id.identify(docs.select("doc_id", "text"), profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines_removed", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 512


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage that a CRC of conversation and turn decides; a null role or text is one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations")
    told, turns = conversation_repair.repair(damaged(conversations))
    line = F.concat("role", F.lit(":"), "text")
    hashes = ordered_sha256(turns.withColumn("line", line), "conv_id", "place", F.col("line"), "\n", "repaired_sha256")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    parts = [conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), told, hashes]
    every = parts[0].unionByName(parts[1], True).unionByName(parts[2], True).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*counts, "audit", "repaired_sha256")])
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, their turns): each begins with the first h turns of the conversation at the hundred below it, h from a CRC of its id, and goes on with its own after its first h."""
    ids = turns.select("conv_id").distinct().select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    first = turns.where("conv_id % 100 = 0 and pos <= 5").withColumnRenamed("conv_id", "base")
    lent = ids.join(first, "base").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", "key", "chars")
    own = turns.join(ids, "conv_id").where(F.col("pos") > F.col("h")).select("conv_id", "pos", "key", "chars")
    lent_n = lent.groupBy("conv_id").agg(F.max("pos").alias("n"))
    own = own.join(ids.select("conv_id", "h"), "conv_id").join(lent_n, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.coalesce("n", F.lit(0))).cast("int").alias("pos"), "key", "chars")
    return ids.select("conv_id"), lent.union(own)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, turns = rebuilt(materialize(prefix_trie.turn_keys(_read(spark, sf_dir, "conversations"))))
    nodes = prefix_trie.build(ids, materialize(turns))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_mix_sources, op3_chat_format, op4_best_fit_packing, op5_nearest_neighbours,
    op6_url_filter, op7_embedding_near_dedup, op8_substring_dedup, op9_language_id, op10_line_dedup,
    op11_token_counts, op12_conversation_repair, op13_prefix_trie,
)}
