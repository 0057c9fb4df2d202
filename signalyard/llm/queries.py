"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, packing, pii, quality, simhash, sketch, suffix_dedup, token_store, toxicity, url_rules
from .common import load, new_path, written

#: A parameter of the operators; the files are not part of this repository.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = written(mixing.mix_sources(mixing.sized(load(spark, sf_dir, "documents"))), "mix-plan")
    return mixing.taken_words(plan).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(load(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"), with_text=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(pii.candidates(load(spark, sf_dir, "documents")), "pii")
    marked = pii.accepted(found, pii.fit(found))
    counts = [pii.count(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    base = F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return marked.select("doc_id", *counts, base, pii.joined(F.col("spans")).alias("spans"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    token_store.write_store(load(spark, sf_dir, "documents"), folder, TOKENIZER)
    return token_store.read_back(spark, folder)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(load(spark, sf_dir, "documents"), with_text=False)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), TOKENIZER)


def op10_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketch.with_next(load(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", sketch.edited(F.col("text"), F.col("head")))
    rows = rows.withColumn("edited_sketch", sketch.sketch(F.col("edited")))
    own, other, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.written_out(own).alias("fingerprint"),
        sketch.written_out(other).alias("edited_fingerprint"),
        sketch.likeness(own, other).alias("near_edited"),
        sketch.likeness(own, following).alias("near_next"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_url_rules": op2_url_rules,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_token_store": op6_token_store,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_sketch": op10_sketch,
}

#: Every string of 200 bytes (400 hex digits) of every text, counted; stretches that repeated ones cover; what is left.
REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS k FROM w) WHERE k > 1),
g AS (SELECT *, sum(CASE WHEN i <= p + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r)),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY 1, 2),
k AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS gone, count(*) AS spans FROM s GROUP BY 1),
j AS (SELECT d.doc_id, h, n, coalesce(gone, 0) AS gone, coalesce(spans, 0) AS spans, list_concat(coalesce(starts, []::BIGINT[]), [n]) AS starts, list_concat([0::BIGINT], coalesce(ends, []::BIGINT[])) AS ends FROM d LEFT JOIN k ON k.doc_id = d.doc_id)
SELECT doc_id, n AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(starts) + 1), lambda x: substr(h, 2 * ends[x] + 1, 2 * (starts[x] - ends[x]))), ''))) AS kept_sha256 FROM j"""

#: Words, windows of five words, lines and their rules, as quality.py has them.
QUALITY = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 4], ' ')) AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, range(0, 5) r(o) GROUP BY 1),
li AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lt AS (SELECT doc_id, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS body FROM li),
lc AS (SELECT *, length(body) AS len, length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS sym, length(regexp_replace(body, '[^|»›]', '', 'g')) AS bars FROM lt),
lf AS (SELECT *, body <> '' AND ((bars >= 4 AND len / (bars + 1.0) <= 14) OR sym > 0.25 * len OR NOT regexp_matches(body, '[\\p{L}\\p{N}]')
  OR (len <= 24 AND regexp_matches(body, 'NAVIGATION')) OR (len <= 400 AND regexp_matches(body, 'BOILERPLATE'))) AS bad FROM lc),
lost AS (SELECT doc_id, sum(CASE WHEN bad THEN length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) ELSE 0 END) AS gone FROM lf GROUP BY 1),
dup AS (SELECT doc_id, sum(k - 1) AS n FROM (SELECT doc_id, line, count(*) AS k FROM li WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost.gone, 0) AS gone
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN lost ON lost.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND gone <= 0.5 * word_chars AS kept FROM b
""".replace("NAVIGATION", quality.NAVIGATION).replace("BOILERPLATE", quality.BOILERPLATE)

#: SQL where it can express an operator; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op3_suffix_dedup": REPEATS, "op8_quality": QUALITY}
