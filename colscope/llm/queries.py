"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colscope.llm import (
    ann, chat, class_ngrams, exact_dedup, line_dedup, mixing, ngram_join, packing, periodic, quality, sharding, substring_dedup, token_alignment,
)
from colscope.llm.common import WORD, remainder, table


def op1_brown_class_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ngrams.scores(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


def op2_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


# How far sources lean to the beginning or the end of the training.
TILT = 0.5


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``position``: the word of the training at which the document is first met, null if it is not taken."""
    mixed = mixing.by_first_position(mixing.mix(table(spark, sf_dir, "documents"), tilt=TILT))
    first = F.when(F.size("passes") > 0, F.floor(F.col("first_position") + 1e-6))
    return mixed.select("document.doc_id", "size", "source_size", "target", "taken", first.alias("position"))


def op5_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


# Characters of a streamed delta; bits of a place in a turn's log, and of the rows of a turn.
DELTA, _STEPS, _ROWS = 1024, 14, 24


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations and conversation -7 as the log that would have led to them: assistants begin with a draft, are
    asked again and stream their text in deltas; others say something first and edit it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.unionByName(extra).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("nth", nth)

    def event(step, kind: str, text) -> Column:
        return F.struct(step.cast("bigint").alias("step"), F.lit(kind).alias("kind"), text.alias("text"))

    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length("text") / DELTA).cast("int") - 1, F.lit(0)))
    deltas = F.transform(pieces, lambda i: event(i + 2, "delta", F.col("text").substr(i * DELTA + 1, F.lit(DELTA))))
    draft = F.array(event(F.lit(0), "message", F.lit("a draft")), event(F.lit(1), "regenerate", F.lit("")))
    first = F.array(event(F.lit(0), "message", F.reverse("text")), event(F.lit(1), "edit", F.col("text")))
    log = rows.select("conv_id", "turn", "role", "nth", F.explode(F.when(F.col("role") == "assistant", F.concat(draft, deltas)).otherwise(first)).alias("e"))
    place = F.coalesce("turn", F.lit(-1)).cast("bigint") * (1 << (_STEPS + _ROWS)) + F.col("nth") * (1 << _STEPS) + F.col("e.step")
    return log.select("conv_id", "turn", place.alias("seq"), "e.kind", "role", "e.text")


def op6_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.render(chat.reconstruct(conversation_events(spark, sf_dir))))


def op7_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "document.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    learn = remainder("doc_id", 3) != 1
    model = quality.fit(documents.filter(learn), quality.trusted_positives(table(spark, sf_dir, "labels")).filter(learn))
    return quality.score(documents, model, ["doc_id"]).select("document.doc_id", "score").select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )


def op10_super_k_mer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op11_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of one weight; grown_shard is the place among forty-one."""
    text = F.coalesce("text", F.lit(""))
    facts = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = sharding.placed(facts, dict.fromkeys(range(40), 1.0), dict.fromkeys(range(41), 1.0))
    return sharding.with_slots(rows).select("document.*", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(table(spark, sf_dir, "documents"))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, text); a tenth of the documents repeats some of its words from one place on, as their key's hash says."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    chosen = documents.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, found).alias("words"))
    n = F.size("words")
    placed = chosen.withColumn("n", n).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(sequence(0, n - 1), i -> get(words, int(if(i < a, i, a + (i - a) % p)))), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))")
    listed = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    rows = found.select("document.doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("longest"), listed.alias("listed"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", (-F.col("longest.start")).alias("start"), "longest.length", (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_brown_class_score, op2_parity_sketch_join, op3_tree_merge_dedup, op4_curriculum_mix, op5_adaptive_scan_ann, op6_event_sourced_chat, op7_fuzzy_line_dedup, op8_pu_quality, op9_vector_packing, op10_super_k_mer_dedup, op11_rendezvous_sharding, op12_token_alignment, op13_periodic_runs)}
