"""The registered queries of this subpackage, each with its SQL or None where SQL cannot express it."""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscope.llm import chat, decontamination, filter_audit, jaccard, mixing, packing, quality_classifier, quality_rules, repeats, spelling, token_files, toxicity, url_filter
from columnscope.llm.storage import materialise, shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The tree is domain, language, source; domains are sets of sources.
MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS = {"web": 50, "books": 30, "forum": 20, "en": 60, "de": 15, "fr": 15, "es": 10}
MIX_EPOCHS, MIX_SEED = 2, 11


def with_domain(documents: DataFrame) -> DataFrame:
    number = F.regexp_extract("source", r"^src([0-9]{1,9})$", 1)
    domain = F.when(number == "0", "web").when((number != "") & (number.cast("long") % 2 == 0), "books").otherwise("forum")
    return documents.withColumn("domain", domain)


def op1_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = with_domain(_table(spark, folder, "documents"))
    counted = materialise(documents.select("doc_id", *MIX_LEVELS, mixing.n_words(F.col("text")).alias("n_tokens")))
    return mixing.mix(counted, MIX_LEVELS, "n_tokens", 1.0, MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_classifier.score(
        _table(spark, folder, "documents"), _table(spark, folder, "labels"), may_learn=lambda id: _fold(id).isin(0, 1), calibrates=lambda id: _fold(id) == 3
    )
    return scored.select("doc_id", (_fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


URL_RULES = (
    url_filter.UrlRule("com", "/", "allow"), url_filter.UrlRule("example.com", "/en/", "block"),
    url_filter.UrlRule("www.example.com", "/en/", "allow"), url_filter.UrlRule("net", "/es/", "block"),
    url_filter.UrlRule("net", "/fr/", "block"),
)


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_table(spark, folder, "pages"), URL_RULES)


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.passages(_table(spark, folder, "documents"))


def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    return chat.digests(chat.format_turns(turns.unionAll(own)))


def op3_token_id_output(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    out = f"{shared_folder(spark)}/tokens-{uuid.uuid4()}"
    segments = token_files.write_tokens(_table(spark, folder, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.document_facts(segments)


def _fold(id):
    """The contract's fold of a document; fold 2 is held out."""
    return F.crc32(id.cast("string")) % 4


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(
        _table(spark, folder, "documents"), _table(spark, folder, "labels"), may_learn=lambda id: _fold(id).isin(0, 1), calibrates=lambda id: _fold(id) == 3
    )
    return scored.select("doc_id", (_fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(_table(spark, folder, "documents"), width=3, threshold=Fraction(9, 10))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.assess(_table(spark, folder, "documents")).drop("failed_rule")


def op11_filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_spelling_variant_grouping(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"), slip=199)


# The host as the contract words it; no page of the given tables has a redirect or canonical link, so SQL needs no aliases.
_OP2_SQL = r"""
WITH cut AS (
    SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS p FROM pages
), rest AS (
    SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM cut
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules (host, path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), hits AS (
    SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM parts t JOIN rules r ON (t.host = r.host OR ends_with(t.host, '.' || r.host)) AND starts_with(t.path, r.path)
    GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS alias_of
FROM parts LEFT JOIN hits USING (page_id)"""

_OP9_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), read AS (
    SELECT conv_id, turn, role, text, role = 'assistant' AS trained,
           length(regexp_replace(text, '(\\|###|</turn>|<\|)', '\\\1', 'g'))
           + length(role) + 15 AS shown
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (trained), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (trained), '')) AS loss_sha256,
       CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM read GROUP BY conv_id"""



def _op1_sql() -> str:
    weights = " ".join(f"WHEN '{k}' THEN {w}" for k, w in MIX_WEIGHTS.items())
    parts = [f"""
WITH counted AS (
    SELECT doc_id, lang, source, CASE WHEN source = 'src0' THEN 'web'
           WHEN regexp_matches(source, '^src[0-9]+$') AND CAST(substr(source, 4) AS BIGINT) % 2 = 0 THEN 'books' ELSE 'forum' END AS domain,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
    FROM documents
), leaves AS (
    SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, {MIX_EPOCHS} * sum(n_tokens)::HUGEINT AS room FROM counted GROUP BY ALL
), given0 AS (SELECT least(sum(room), sum(tokens)) AS given FROM leaves)"""]
    for depth in range(1, len(MIX_LEVELS) + 1):
        path, up = ", ".join(MIX_LEVELS[:depth]), MIX_LEVELS[:depth - 1]
        parent = f"PARTITION BY {', '.join(up)}" if up else ""
        on = f"USING ({', '.join(up)})" if up else "ON true"
        parts.append(f""", nodes{depth} AS (
    SELECT n.*, CASE {MIX_LEVELS[depth - 1]} {weights} ELSE 1 END AS weight, p.given AS budget
    FROM (SELECT {path}, sum(room) AS room FROM leaves GROUP BY ALL) n JOIN given{depth - 1} p {on}
), ordered{depth} AS (
    SELECT *, budget - coalesce(sum(room) OVER before, 0) AS left_over,
           sum(weight) OVER ({parent}) - coalesce(sum(weight) OVER before, 0) AS weights,
           row_number() OVER ({parent} ORDER BY room::DOUBLE / weight, {path}) AS place
    FROM nodes{depth} WHERE room > 0
    WINDOW before AS ({parent} ORDER BY room::DOUBLE / weight, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened{depth} AS (
    SELECT *, min(CASE WHEN room * weights > weight * left_over THEN place END) OVER ({parent}) AS first_open FROM ordered{depth}
), rests{depth} AS (
    SELECT *, place >= coalesce(first_open, place + 1) AS is_open,
           max(CASE WHEN place = first_open THEN left_over END) OVER ({parent}) AS rest,
           max(CASE WHEN place = first_open THEN weights END) OVER ({parent}) AS by_weight FROM opened{depth}
), shares{depth} AS (
    SELECT *, CASE WHEN is_open THEN (weight * rest)::HUGEINT // by_weight::HUGEINT ELSE room END AS share FROM rests{depth}
), given{depth} AS (
    SELECT {path}, share + CASE WHEN is_open AND place - first_open + 1 <= rest - sum(CASE WHEN is_open THEN share END) OVER ({parent}) THEN 1 ELSE 0 END AS given
    FROM shares{depth}
)""")
    depth = len(MIX_LEVELS)
    parts.append(f""", plan AS (
    SELECT domain, lang, source, (given // tokens)::INT AS whole, given % tokens AS rest FROM given{depth} JOIN leaves USING (domain, lang, source) WHERE given > 0
), placed AS (
    SELECT c.*, whole, rest, coalesce(sum(n_tokens) OVER (
               PARTITION BY domain, lang, source ORDER BY md5('{MIX_SEED}:' || whole || ':' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM counted c JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, e.epoch::INT AS epoch, n_tokens AS taken
FROM placed JOIN (SELECT unnest(range({MIX_EPOCHS})) AS epoch) e ON e.epoch < whole
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, whole, least(n_tokens, rest - start)::BIGINT FROM placed WHERE start < rest""")
    return "".join(parts)

_OP11_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), failed AS (
    SELECT doc_id, part,
           (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
           + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text))::INT
           + 8 * regexp_matches(text, '[#$%&*|]')::INT
           + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
    FROM words
), marked AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), by_mask AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed LEFT JOIN marked USING (doc_id) GROUP BY ALL
), letters (letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
), steps AS (
    SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS before FROM orders, range(1, 6) r(step)
), filled AS (SELECT filter_order, step, bit, coalesce(before, 0) AS before FROM steps
), counted AS (
    SELECT part, filter_order, step, bit,
           coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM by_mask, filled GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM counted"""

# DuckDB has no crc32: its table is made by the rule, and bytes are folded over it.
_OP13_SQL = r"""
WITH RECURSIVE bits (i, step, c) AS (
    SELECT i, 0, i FROM range(256) r(i)
    UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8
), crc (c) AS (SELECT list(c ORDER BY i) FROM bits WHERE step = 8
), runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS bytes FROM runs GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)),
               lambda h, b: xor(h >> 8, c[(xor(h, b) & 255) + 1])), 4294967295) AS h
    FROM counted, crc
), slipped AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 100) r(i) WHERE i <= length(word)
), pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.rest, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS near_n, arg_min(near, (-near_n, near)) AS near FROM pairs GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
), ways (word, root, form) AS (
    SELECT word, word, form FROM formed
    UNION ALL SELECT w.word, f.word, f.form FROM ways w JOIN formed f ON f.word = w.form
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN ways w ON w.word = f.word AND w.form IS NULL"""

ENTRIES = {
    "op1_source_mixing": (op1_source_mixing, _op1_sql()),
    "op2_url_filters": (op2_url_filters, _OP2_SQL),
    "op3_token_id_output": (op3_token_id_output, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_benchmark_decontamination": (op5_benchmark_decontamination, None),
    "op6_ngram_jaccard_join": (op6_ngram_jaccard_join, None),
    "op7_quality_rules": (op7_quality_rules, None),
    "op8_quality_classifier": (op8_quality_classifier, None),
    "op9_chat_formatting": (op9_chat_formatting, _OP9_SQL),
    "op10_substring_dedup": (op10_substring_dedup, None),
    "op11_filter_interaction_audit": (op11_filter_interaction_audit, _OP11_SQL),
    "op12_best_fit_packing": (op12_best_fit_packing, None),
    "op13_spelling_variant_grouping": (op13_spelling_variant_grouping, _OP13_SQL),
}
