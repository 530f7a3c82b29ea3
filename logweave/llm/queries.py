"""The queries of the text operators, each over a whole table, and their SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.llm import alignment, decontamination, filter_audit, mixing, near_duplicates, pii, preferences, quality, secrets, token_counts, token_files, topk, toxicity
from logweave.plans.registry import query
from logweave.session import checkpointed, fresh_path, use_utc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text under piece_bpe_32k, and whether they pass 4,096."""
    docs = documents(spark, sf_dir).select("doc_id", token_counts.utf8_bytes().alias("n_bytes"), "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text under byte_bpe_50k with the end id 2, written to files and read back."""
    folder = fresh_path(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.read_token_files(spark, folder)


@query("op7_mix_sources")
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    return mixing.mix_sources(documents(spark, sf_dir)).taken()


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii")
    counts = [pii.count_kind(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.span_text(F.col("pii"), pii.BASE_KINDS), 256).alias("base_sha256"), pii.span_text(F.col("pii")).alias("spans")
    )


#: All equal words of a document and an item, by their shift; the best stretch begins at one of them.
#: Characters of scripts without blanks are set apart first; items below six words count where all of them stand in a row.
_LEAK_WORDS = (
    "regexp_extract_all(regexp_replace(lower(text), '([\\x{0E00}-\\x{0EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}"
    "\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}])', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+')"
)
LEAKS_SQL = rf"""
WITH d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {_LEAK_WORDS} AS w FROM documents)),
b AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, {_LEAK_WORDS} AS w FROM benchmark)),
m AS (SELECT d.doc_id, b.item_id, b.n, d.pos - b.pos AS shift, b.pos AS place FROM d JOIN b ON b.word = d.word),
s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY place RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS equal FROM m),
hit AS (SELECT DISTINCT doc_id, item_id FROM s WHERE equal >= CASE WHEN n < 6 THEN n ELSE ceil(0.75 * least(n, 13)) END),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id)
SELECT o.doc_id, coalesce(f.n_items, 0) AS n_items, coalesce(f.items, '') AS items, f.items IS NULL AS kept FROM documents AS o LEFT JOIN found AS f ON f.doc_id = o.doc_id
"""


@query("op8_decontaminate", LEAKS_SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document holds."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    items = use_utc(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = checkpointed(decontamination.find_leaks(docs, items))
    return decontamination.mark_leaks(docs, leaks)


PREFERENCES_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations),
l AS (SELECT conv_id, count(*) AS size, max(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS last FROM t GROUP BY conv_id),
a AS (SELECT l.conv_id, t.text AS answer FROM l JOIN t ON t.conv_id = l.conv_id AND t.n = l.last),
c AS (SELECT t.conv_id, t.n, t.role, t.text, 'chosen' AS side FROM t),
r AS (SELECT t.conv_id, t.n, t.role, CASE WHEN t.n = l.last THEN coalesce(o.answer, '') ELSE t.text END AS text, 'rejected' AS side
      FROM t JOIN l USING (conv_id) LEFT JOIN a AS o ON o.conv_id = t.conv_id + 1 WHERE l.last = 0 OR t.n <= l.last),
m AS (SELECT c.conv_id, min(CASE WHEN r.n IS NULL OR r.role <> c.role OR r.text <> c.text THEN c.n END) - 1 AS broken, max(c.n) AS size
      FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.n = c.n GROUP BY c.conv_id),
p AS (SELECT conv_id, coalesce(broken, size) AS n_common FROM m),
w AS (SELECT s.conv_id, s.side, s.n, s.role, '<|' || s.role || '|>' || chr(10) || s.text || '<|end|>' || chr(10) AS shown, length(s.role) AS role_size, length(s.text) AS text_size, p.n_common
      FROM (SELECT * FROM c UNION ALL SELECT * FROM r) s JOIN p USING (conv_id)),
x AS (SELECT *, sum(length(shown)) OVER (PARTITION BY conv_id, side ORDER BY n) - length(shown) + role_size + 5 AS start FROM w WHERE n > n_common),
y AS (SELECT conv_id, side, string_agg(shown, '' ORDER BY n) AS shown,
        coalesce(string_agg(start || ':' || (start + text_size), ',' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS mask FROM x GROUP BY conv_id, side),
q AS (SELECT conv_id, string_agg(shown, '' ORDER BY n) AS prompt FROM w WHERE side = 'chosen' AND n <= n_common GROUP BY conv_id)
SELECT p.conv_id, p.n_common, coalesce(q.prompt, '') AS prompt, coalesce(yc.shown, '') AS chosen_text, coalesce(yr.shown, '') AS rejected_text,
  coalesce(yc.mask, '') AS chosen_mask, coalesce(yr.mask, '') AS rejected_mask
FROM p LEFT JOIN q USING (conv_id) LEFT JOIN y AS yc ON yc.conv_id = p.conv_id AND yc.side = 'chosen'
LEFT JOIN y AS yr ON yr.conv_id = p.conv_id AND yr.side = 'rejected'
"""


@query("op4_preferences", PREFERENCES_SQL)
def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference pair for every conversation, its counterpart ending in the next one's answer."""
    turns = use_utc(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return preferences.format_preferences(preferences.pairs_by_next_answer(preferences.conversations(turns)))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every text and the verdict of the voting rules."""
    judged = quality.judge_quality(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    found = secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets")
    counts = [secrets.count_kind(F.col("secrets"), k).alias(f"n_{k}") for k in secrets.BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.span_text(F.col("secrets"), secrets.BASE_KINDS), 256).alias("base_sha256"), secrets.span_text(F.col("secrets")).alias("spans")
    )


@query("op2_near_duplicates")
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingles agree to four fifths."""
    found = near_duplicates.near_duplicates(documents(spark, sf_dir), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from the labelled rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, use_utc(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of byte_bpe_50k and piece_bpe_32k meet in every text."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return alignment.link_scores(alignment.align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))


#: Scores of all pairs of a query and another row, by position; vectors without a common position score 0.
TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT r, vec_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM v),
m AS (SELECT q.r AS qr, c.r AS cr, sum(q.w * c.w)::BIGINT AS score FROM t AS q JOIN t AS c ON c.i = q.i AND c.r <> q.r WHERE q.vec_id % 100 = 0 GROUP BY q.r, c.r),
p AS (SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(m.score, 0) AS score FROM v AS q JOIN v AS c ON c.r <> q.r LEFT JOIN m ON m.qr = q.r AND m.cr = c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank, vec_id, score FROM p) WHERE rank <= 10
"""


@query("op12_top_k", TOP_K_SQL)
def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of the highest integer inner product for every hundredth vector."""
    vectors = use_utc(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(topk.quantized(vectors), k=10, every=100)


#: Orders by joining five letters; a word list is a split without empty strings.
FILTERS_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
b AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, step, bits[step] AS own, (coalesce(list_sum(bits[1:step - 1]), 0))::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost,
  any_value(own) AS own FROM m, s GROUP BY part, filter_order, step),
h AS (SELECT part, own, sum(removed)::BIGINT AS shapley FROM g GROUP BY part, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM g JOIN h USING (part, own)
"""


@query("op13_filter_audit", FILTERS_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, for every language."""
    return filter_audit.audit_filters(documents(spark, sf_dir), use_utc(spark).read.parquet(f"{sf_dir}/labels.parquet"))
