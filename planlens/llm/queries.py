"""The registered queries of the training-data operators, and the same results as SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from planlens.llm import (
    chat_format,
    context_tree,
    hyperplane_tree,
    importance_resampling,
    mil_toxicity,
    paragraph_sketch,
    record_files,
    robust_outliers,
    rule_ensemble,
    simhash,
    source_mix,
    word_bpe,
)
from planlens.llm.common import WORD, store, store_path, table, whole_text
from planlens.llm.token_rollup import TokenRollup

#: id that ends each document in record files; fixed value.
END_ID = 2
#: The text of both turns of conversation -1; fixed value.
MARKS = "<|im_end|><|im_start|>assistant ok"


#: What the second tokenizer version counts: runs of letters, runs of digits, and every other character that is no white space.
FINER = r"[\p{L}\p{M}]+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]"


def op1_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return context_tree.score(table(spark, folder, "documents"))


def op2_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return robust_outliers.verdicts(table(spark, folder, "documents"))


def op3_rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    return rule_ensemble.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), 3, 1)


def op4_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = word_bpe.encode_decode(table(spark, folder, "documents"), path, "doc_id")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches: all documents; exact copies of a smaller doc_id go; other languages than English are counted anew.

    The first two are delivered twice, which changes nothing.
    """
    text = whole_text(F.col("text"))
    docs = store(
        table(spark, folder, "documents").select(
            "doc_id",
            "source",
            "lang",
            F.md5(text).alias("digest"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
            F.regexp_count(text, F.lit(FINER)).cast("long").alias("finer"),
        ),
        "counted",
    )
    kept = docs.groupBy("digest").agg(F.min("doc_id").alias("kept"))
    copies = docs.join(kept, "digest").where("doc_id > kept")
    load = docs.withColumns({"op": F.lit("insert"), "version": F.lit("words"), "n_tokens": F.col("words")})
    drop = copies.select(F.lit("delete").alias("op"), "doc_id", "source", "lang", F.lit("words").alias("version"), F.col("words").alias("n_tokens"))
    anew = docs.join(copies.select("doc_id").distinct(), "doc_id", "left_anti").where("lang <> 'en'")
    anew = anew.withColumns({"op": F.lit("revise"), "version": F.lit("finer"), "n_tokens": F.col("finer")})
    rollup = TokenRollup(spark, store_path(spark, "rollup"))
    for batch, changes in (("load", load), ("drop", drop), ("load", load), ("recount", anew), ("drop", drop)):
        rollup.apply(batch, changes)
    return rollup.totals()


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-1, 0, "user", MARKS), (-1, 1, "assistant", MARKS)], turns.schema)
    done = chat_format.format_conversations(turns.unionByName(marked))
    read = done.select(
        "conv_id",
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat_format.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_merged",
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_merged",
    )


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_paragraph_sketch(spark: SparkSession, folder: str) -> DataFrame:
    pairs = paragraph_sketch.edited_pairs(table(spark, folder, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op9_record_files(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = store_path(spark, "records")
    index = record_files.write_records(table(spark, folder, "documents"), files, path, END_ID)
    return record_files.read_with_starts(index, files)


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.mix(table(spark, folder, "documents"))


def op11_mil_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """With the number of sentences, how many offend, and where the worst one lies."""
    found = mil_toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), 4, 2)
    worst = F.get(F.array_sort(F.transform("offending", lambda x: F.struct((-x["score"]).alias("s"), x["start"], x["end"]))), F.lit(0))
    return found.select(
        "doc_id",
        "held_out",
        "score",
        "predicted",
        "n_sentences",
        F.size("offending").cast("long").alias("n_offending"),
        worst["start"].alias("worst_start"),
        worst["end"].alias("worst_end"),
    )


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_hyperplane_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of ids that 7 divides are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hyperplane_tree.vectors(table(spark, folder, "embeddings").withColumn("label", moved))
    return hyperplane_tree.hard_negatives(rows)


QUERIES = {
    "op1_context_tree": op1_context_tree,
    "op2_robust_outliers": op2_robust_outliers,
    "op3_rule_ensemble": op3_rule_ensemble,
    "op4_word_bpe": op4_word_bpe,
    "op5_token_rollup": op5_token_rollup,
    "op6_chat_format": op6_chat_format,
    "op7_simhash": op7_simhash,
    "op8_paragraph_sketch": op8_paragraph_sketch,
    "op9_record_files": op9_record_files,
    "op10_source_mix": op10_source_mix,
    "op11_mil_toxicity": op11_mil_toxicity,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_hyperplane_tree": op13_hyperplane_tree,
}

ORACLE_SQL = {
    "op5_token_rollup": rf"""
        WITH counted AS (
            SELECT doc_id, source, lang, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
                   len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words,
                   len(regexp_extract_all(coalesce(text, ''), '{FINER}')) AS finer
            FROM documents)
        SELECT source, lang, CASE WHEN lang <> 'en' THEN 'finer' ELSE 'words' END AS version,
               count(*) AS n_docs, CAST(sum(CASE WHEN lang <> 'en' THEN finer ELSE words END) AS BIGINT) AS n_tokens
        FROM counted WHERE doc_id = kept GROUP BY ALL""",
    "op10_source_mix": rf"""
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
                   md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS n,
                   row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM sized GROUP BY source),
        weighed AS (
            SELECT *, CASE idx % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM sources),
        ordered AS (
            SELECT *, (CAST(sum(n) OVER () AS DOUBLE) * 1.5
                       - coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY 2 * n / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2 * n / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reached
            FROM weighed),
        targets AS (SELECT *, least(2.0::DOUBLE * n, max(reached) OVER () * w) AS target FROM ordered),
        placed AS (
            SELECT s.doc_id, s.size, t.idx, t.n, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS take,
                   CAST(sum(s.size) OVER (PARTITION BY t.idx ORDER BY s.k, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS pos
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        shares AS (
            SELECT idx, slots, CAST(sum(slots) OVER (ORDER BY idx) AS BIGINT) - slots AS first, CAST(sum(slots) OVER () AS BIGINT) AS every
            FROM (SELECT idx, CAST(ceil(floor(target + 0.5) / {source_mix.BLOCK}) AS BIGINT) AS slots FROM targets)),
        near AS (SELECT any_value(every) AS every, CAST(round_even(any_value(every) * (sqrt(5) - 1) / 2, 0) AS BIGINT) AS m FROM shares),
        -- the quotients of Euclid's steps: the step with the smallest largest one spreads its multiples best
        euclid AS (
            SELECT every, m, m + d AS g, every AS a, m + d AS b, 0::BIGINT AS most FROM near, range(-63, 64) t(d) WHERE m + d > 0 AND m + d < every
            UNION ALL SELECT every, m, g, b, a % b, greatest(most, a // b) FROM euclid WHERE b <> 0),
        step AS (SELECT CASE WHEN any_value(every) < 3 THEN 1 ELSE first(g ORDER BY most, abs(g - m), g) END AS g FROM euclid WHERE b = 0 AND a = 1),
        times AS (SELECT slot, CAST((CAST(slot AS HUGEINT) * coalesce(g, 1)) % every AS BIGINT) AS point FROM near, step, range(every) t(slot)),
        schedule AS (
            SELECT idx, slot, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS block
            FROM times JOIN shares ON point >= first AND point < first + slots),
        begun AS (
            SELECT *, CASE WHEN size > 0 AND pos < take THEN pos // {source_mix.BLOCK} END AS block0,
                   CASE WHEN size > 0 AND n + pos < take THEN (n + pos) // {source_mix.BLOCK} END AS block1 FROM placed)
        SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target,
               CAST(greatest(0, least(take, pos + size) - pos) + greatest(0, least(take, n + pos + size) - n - pos) AS BIGINT) AS taken,
               s0.slot AS first_slot, s1.slot AS second_slot
        FROM begun b LEFT JOIN schedule s0 ON s0.idx = b.idx AND s0.block = block0 LEFT JOIN schedule s1 ON s1.idx = b.idx AND s1.block = block1""",
    # crc32 goes bit by bit over each distinct word: the remainder is shifted, and 3988292384 is the polynomial.
    "op12_importance_resampling": rf"""
        WITH split AS (
            SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{importance_resampling.WORD}') AS w FROM documents),
        aims AS (
            SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{importance_resampling.WORD}')) AS w FROM benchmark),
        places AS (SELECT n, unnest(w) AS w FROM split),
        known AS (SELECT DISTINCT w FROM (SELECT w FROM places UNION ALL SELECT w FROM aims)),
        hashed AS (
            SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(
                [[(('0x' || b)::BIGINT >> k) & 1 for k in range(8)] for b in regexp_extract_all(hex(encode(w)), '..')])),
                lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), 4294967295) % 10000 AS b FROM known),
        source AS (SELECT b, count(*) AS s FROM places JOIN hashed USING (w) GROUP BY b),
        target AS (SELECT b, count(*) AS t FROM aims JOIN hashed USING (w) GROUP BY b),
        gains AS (
            SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM source) + 10000)::DOUBLE
                   / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + 10000)::DOUBLE))) AS BIGINT) AS gain
            FROM (SELECT DISTINCT b FROM hashed) LEFT JOIN source USING (b) LEFT JOIN target USING (b)),
        sums AS (SELECT n, sum(gain) AS weight FROM places JOIN hashed USING (w) JOIN gains USING (b) GROUP BY n),
        scored AS (
            SELECT n, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                   CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT
                        + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
            FROM split LEFT JOIN sums USING (n)),
        placed AS (
            SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () * 10 // 100 AS drawn
            FROM scored WHERE n_features >= 20)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank
        FROM scored LEFT JOIN placed USING (n)""",
    "op13_hyperplane_tree": """
        WITH rows_ AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * x::DOUBLE) for x in embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
             AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
        QUALIFY row_number() OVER w <= 5""",
}
