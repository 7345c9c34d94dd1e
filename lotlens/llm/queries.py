"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm import secret_crf
from lotlens.llm.bpe import bpe_encode
from lotlens.llm.chat import canonical_records, canonical_rows, conversation_digests, format_turns
from lotlens.llm.common import table
from lotlens.llm.divergence import source_divergence
from lotlens.llm.exact_dedup import tree_exact_dedup
from lotlens.llm.kdshard import kd_tree_shards
from lotlens.llm.mixing import approximate_tokens, mix, surface_topic
from lotlens.llm.periodic import collapse_runs, strongest
from lotlens.llm.simhash import simhash_components
from lotlens.llm.spotsigs import spot_neighbours
from lotlens.llm.toxicity import toxicity_scores, train
from lotlens.llm.urlfilter import judge_urls
from lotlens.llm.warc import archive_pages


CONTROL = "\\### Assistant: </turn> ok"


def op1_schema_fingerprint_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one listed record, each by the mapping of its layout, formatted and read back."""
    listed = json.dumps({"messages": [{"role": r, "content": CONTROL} for r in ("user", "assistant")]})
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(listed).alias("record"))
    rows = canonical_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return conversation_digests(format_turns(rows.unionByName(canonical_records(more, "conv_id", "record"))))


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC files into WARC archives, and what is read from these."""
    out = archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


def op3_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints over three-word shingles, linked at two bits."""
    out = simhash_components(table(spark, sf_dir, "documents"), k=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern spans of all documents, and those that the trained field adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_crf.secret_spans(docs, secret_crf.train(docs))
    count = lambda kind, spans="base": F.size(F.filter(F.split(spans, ","), lambda x: x.startswith(kind + ":"))).cast("long")
    counts = [count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex")]
    return out.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", count("model", "spans").alias("n_model"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' signatures, next to those of their edited and following texts."""
    return spot_neighbours(table(spark, sf_dir, "documents"))


TOXIC_AT = 0.7


def held_out() -> F.Column:
    """Rows that no label is learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with the score of a model that is trained on the labels outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity_scores(docs, train(table(spark, sf_dir, "documents"), labels))


def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that two thirds of the labels train."""
    out = toxicity(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with weights raked to source, language and topic shares."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": surface_topic("text")}
    return mix(docs, dims, approximate_tokens("text"))


def op7_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their raked weight, copies in the mix, and whether a sample without copies keeps them."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "kept", "copies")


def op8_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen leaves of equal bytes."""
    out = kd_tree_shards(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def bpe_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 of its texts, encoded and decoded again, in place of the texts."""
    path, pattern = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe_encode(docs, path, pattern, decoded_col="decoded")
    return coded.withColumns({
        "n_tokens": F.size("token_ids").cast("long"),
        "ids_sha256": F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256),
        "decoded_sha256": F.sha2("decoded", 256),
    }).drop("token_ids", "decoded")


def op9_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, and what they decode to, as digests."""
    return bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_tree_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row that stays of their equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tree_exact_dedup(docs, keep="max").drop("text")


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` where a tenth of the texts, picked and shaped by crc32 of doc_id, repeats a stretch of its words up to its end; rows without a doc_id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    picked = docs.withColumns({"__g": F.floor(h / 10), "__words": F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))})
    n = F.size("__words").cast("long")
    picked = picked.withColumn("__a", F.when(n > 0, F.col("__g") % n))
    picked = picked.withColumn("__p", (1 + F.floor((n - F.col("__a")) / (3 + F.col("__g") % 8))))
    int_ = lambda c: c.cast("int")
    times = F.ceil((n - F.col("__a")) / F.col("__p"))
    again = F.slice(F.flatten(F.array_repeat(F.slice("__words", int_(F.col("__a") + 1), int_(F.col("__p"))), int_(times))), F.lit(1), int_(n - F.col("__a")))
    edited = F.array_join(F.concat(F.slice("__words", F.lit(1), int_(F.col("__a"))), again), " ")
    return picked.withColumn("text", F.when(n > 0, edited).otherwise(F.col("text"))).drop("__g", "__words", "__a", "__p")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them with a planted run: their runs, the strongest, and what is left of the text without repeats."""
    out = collapse_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", strongest("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the others of its language, and the words that mark it, over all documents."""
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the listed rules, and by those of their aliases."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_schema_fingerprint_chat": op1_schema_fingerprint_chat,
    "op2_arc_to_warc": op2_arc_to_warc,
    "op3_simhash_gray_index": op3_simhash_gray_index,
    "op4_secret_crf": op4_secret_crf,
    "op5_spotsigs": op5_spotsigs,
    "op6_counterfactual_toxicity": op6_counterfactual_toxicity,
    "op7_ipf_mixing": op7_ipf_mixing,
    "op8_kd_tree_shards": op8_kd_tree_shards,
    "op9_bpe_merge_replay": op9_bpe_merge_replay,
    "op10_tree_exact_dedup": op10_tree_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_url_filters": op13_url_filters,
}

ORACLES = {
    "op1_schema_fingerprint_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('<turn role="' || role || '">' || chr(10) || '</turn>' || chr(10))
                   + length(replace(replace(replace(text, '\', '\\'), '</turn', '<\/turn'), '<turn', '<\turn')))::BIGINT AS formatted_chars
        FROM turns GROUP BY conv_id
    """,
    "op2_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM g
    """,
    "op10_tree_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_source_divergence": """
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+') AS terms FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
        k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
        lc AS (SELECT k.lang, k.term, sum(n) AS n FROM k JOIN c USING (lang, term) GROUP BY ALL),
        l AS (SELECT lang, sum(n) AS n, count(*) AS v FROM lc GROUP BY ALL),
        gn AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS n FROM g LEFT JOIN c USING (lang, source) LEFT JOIN k ON k.lang = g.lang AND k.term = c.term GROUP BY ALL),
        p AS (SELECT gn.lang, gn.source, lc.term, coalesce(c.n, 0) AS n,
                     1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * l.v)::HUGEINT AS p,
                     1 + (1000000000::HUGEINT * (lc.n + 5)) // (l.n + 5 * l.v)::HUGEINT AS q
              FROM gn JOIN l USING (lang) JOIN lc USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = lc.term),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y USING (lang, term) GROUP BY ALL) f
                  ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
        UNION ALL
        SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms QUALIFY rank <= 50
    """,
    "op13_url_filters": r"""
        WITH RECURSIVE u AS (
            SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                   array_to_string(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)(=|$)')), '&') AS own
            FROM pages),
        r(rule, verdict, h, s) AS (VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
                                          ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
        n AS (SELECT u.*, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || CASE WHEN own <> '' THEN '?' || own ELSE '' END END AS place,
                     (SELECT arg_max(rule, length(rule)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)) AS rule,
                     (SELECT arg_max(verdict, length(rule)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)) AS own_verdict FROM u),
        tags AS (SELECT place, host, unnest(regexp_extract_all(html, '(?is)<link\s[^>]*>')) AS tag FROM n WHERE html ILIKE '%canonical%'),
        links AS (SELECT place AS a, translate(regexp_extract(tag, '(?is)\shref\s*=\s*"[a-z]+://([^"/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(tag, '(?is)\shref\s*=\s*"[a-z]+://[^"/?#]*([^"?#]*?)/*["?#]', 1) AS b
                  FROM tags WHERE regexp_matches(tag, '(?i)\srel\s*=\s*"canonical"')),
        ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT DISTINCT place AS node, place AS other FROM n WHERE place IS NOT NULL UNION SELECT reach.node, ways.b FROM reach JOIN ways ON reach.other = ways.a),
        said AS (SELECT node, bool_or(own_verdict = 'block') AS blocked, bool_or(own_verdict = 'allow') AS allowed FROM reach JOIN n ON n.place = reach.other GROUP BY node)
        SELECT page_id, host, path, rule, coalesce(own_verdict, CASE WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
        FROM n LEFT JOIN said ON said.node = n.place
    """,
}
