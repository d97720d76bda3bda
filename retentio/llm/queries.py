"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm import align, bpe, chats, hmm, mixing, quality, resample, rules, shards, simhash, sketches, spans, topk
from retentio.session import materialize, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


# --- 1: mixing -----------------------------------------------------------------------------

WEIGHTS = (5.0, 2.0, 1.0)
CURRICULUM = (  # heavy sources fade, light ones grow towards the end of training
    mixing.Schedule((0.0, 1.0), (1.2, 0.8)),
    mixing.Schedule((0.0, 1.0), (1.0, 1.0)),
    mixing.Schedule((0.0, 0.5, 1.0), (0.6, 1.0, 1.4)),
)
MAX_REPEATS = 3
FILLERS = 2  # as in the SQL; the pipeline skips what does not fit instead


@query
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    planned = mixing.plan(table(spark, folder, "documents"), WEIGHTS, CURRICULUM, MAX_REPEATS, FILLERS)
    ordered = mixing.in_order(planned)
    return ordered.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def _inverse_sql(schedule: mixing.Schedule) -> str:
    cases = []
    for before, start, rate, slope in reversed(schedule.segments()):
        q = f"greatest(share - {before!r}::DOUBLE, 0.0)"
        root = f"sqrt(greatest({rate * rate!r}::DOUBLE + {2.0 * slope!r}::DOUBLE * {q}, 0.0))"
        time = f"{start!r}::DOUBLE + CASE WHEN {q} > 0 THEN 2.0::DOUBLE * {q} / ({rate!r}::DOUBLE + {root}) ELSE 0.0 END"
        cases.append(f"WHEN share >= {before!r}::DOUBLE THEN {time}")
    return f"least(CASE {' '.join(cases)} END, 1.0::DOUBLE)"


def _fill_sql(k: int) -> str:
    return f"""
f{k}_room AS (SELECT grp, max(target) - sum(size * (passes + extra)) AS room FROM f{k - 1} GROUP BY grp),
f{k}_best AS (SELECT grp, max(struct_pack(a := size, b := upto)).b AS chosen FROM f{k - 1} JOIN f{k}_room USING (grp)
  WHERE size > 0 AND passes + extra < 3 AND size <= room GROUP BY grp),
f{k} AS (SELECT f{k - 1}.* EXCLUDE (extra), extra + CASE WHEN size > 0 AND upto = chosen THEN 1 ELSE 0 END AS extra
  FROM f{k - 1} LEFT JOIN f{k}_best USING (grp))"""


SQL["op1_mix_sources"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') || (source IS NULL)::VARCHAR AS grp,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('29|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS o FROM documents),
r AS (SELECT *, sum(size) OVER (PARTITION BY grp ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM d),
s AS (SELECT grp, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY grp),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, 3 * source_size AS cap FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, rank % 3 AS class FROM k),
c AS (SELECT *, weight * ((sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))) > cap AS capped
  FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT ((sum(source_size) - coalesce(sum(cap) FILTER (capped), 0))::DOUBLE / (sum(weight) FILTER (NOT capped))) AS level FROM c),
t AS (SELECT grp, source_size, class, CASE WHEN capped THEN cap::DOUBLE ELSE weight * level END AS target FROM c, l),
f0 AS (SELECT r.doc_id, r.grp, size, upto, source_size, class, target, 0 AS extra,
    (upto <= target)::INT + (source_size + upto <= target)::INT + (2 * source_size + upto <= target)::INT AS passes
  FROM r JOIN t USING (grp)),{_fill_sql(1)},{_fill_sql(2)},
p AS (SELECT *, CASE WHEN passes > 0 THEN (upto - size / 2.0::DOUBLE) / target WHEN extra > 0 THEN 1.0::DOUBLE END AS share FROM f2)
SELECT doc_id, size, source_size, target, (size * (passes + extra))::BIGINT AS taken,
  round(CASE WHEN share IS NULL THEN NULL WHEN class = 0 THEN {_inverse_sql(CURRICULUM[0])}
    WHEN class = 1 THEN {_inverse_sql(CURRICULUM[1])} ELSE {_inverse_sql(CURRICULUM[2])} END, 9) AS position
FROM p"""


# --- 3: sharding ---------------------------------------------------------------------------

SHARDS = 40


@query
def op3_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = shards.manifest(table(spark, folder, "documents"), SHARDS, ["doc_id"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


# --- 8: repeated spans ---------------------------------------------------------------------

WINDOW = 35


@query
def op8_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    kept = spans.without_repeats(table(spark, folder, "documents").select("doc_id", "text"), WINDOW)
    return kept.select("doc_id", "n_words", "n_removed", spans.words_digest("text").alias("kept_sha256"))


SQL["op8_repeated_spans"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
cov AS (SELECT DISTINCT r, i + k AS p FROM rep, (SELECT unnest(range({WINDOW})) AS k)),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN cov USING (r, p) GROUP BY word.r),
lost AS (SELECT r, count(*) AS n FROM cov GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)"""


# --- 9: SimHash ----------------------------------------------------------------------------

SIMHASH_SHINGLE, SIMHASH_BITS = 3, 2


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), SIMHASH_SHINGLE, SIMHASH_BITS)
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


# --- 10: byte-level BPE --------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), RANKS)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def counted(docs: DataFrame) -> DataFrame:
    """Bring ``n_chars`` up to date with the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


# --- 5: quality rules ----------------------------------------------------------------------


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    voted = materialize(rules.with_votes(rules.with_statistics(docs).drop("text")), "votes")
    verdicts = rules.judged(voted, rules.fit(voted))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


# --- 4: fingerprints -----------------------------------------------------------------------


@query
def op4_scaled_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.edit_report(table(spark, folder, "documents"))


# --- 6: language model ---------------------------------------------------------------------


def _remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id is empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


@query
def op6_hmm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = _remainder("doc_id", 7) == 2
    tokens = hmm.blocks(docs, held_out)
    words = hmm.vocabulary(tokens)
    model, _ = hmm.train(tokens, words)
    return hmm.score(tokens, words, model)


# --- 2: quality classifier -----------------------------------------------------------------

QUALITY_CUT = 0.3


@query
def op2_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = materialize(quality.with_statistics(docs), "statistics")
    held_out = _remainder("doc_id", 5) == 0
    model = quality.train(rows, table(spark, folder, "labels"), held_out)
    scored = quality.with_scores(rows, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted")
    )


# --- 7: chat formatting --------------------------------------------------------------------


@query
def op7_format_chats(spark: SparkSession, folder: str) -> DataFrame:
    return chats.format_chats(table(spark, folder, "conversations"))


SQL["op7_format_chats"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT *, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
e AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM r WHERE position = n_turns - 1 GROUP BY prefix),
m AS (SELECT e.* FROM e ANTI JOIN (SELECT prefix FROM r WHERE position < n_turns - 1) p ON e.prefix = p.prefix)
SELECT r.conv_id, n_turns, copies, position, role,
  '<|im_start|>' || role || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS rendered
FROM r JOIN m ON r.conv_id = m.conv_id"""


# --- 13: exact top-k search ----------------------------------------------------------------

TOP_K, QUERY_EVERY, SCALE = 10, 100, 1024


@query
def op13_norm_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", SCALE)
    return topk.top_k(vectors, F.col("_id") % QUERY_EVERY == 0, TOP_K)


SQL["op13_norm_topk"] = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))), false)),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= {TOP_K}"""


# --- 11: importance resampling -------------------------------------------------------------

RESAMPLE_PERCENT, RESAMPLE_MIN_WORDS = 10, 20


@query
def op11_importance_resample(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample.resample(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), RESAMPLE_PERCENT, RESAMPLE_MIN_WORDS
    )
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# --- 12: cross-tokenizer alignment ---------------------------------------------------------


@query
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align.alignment_report(table(spark, folder, "documents"))
