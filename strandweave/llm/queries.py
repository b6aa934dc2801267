"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import fingerprints, language_id, packing, quality, secrets, sentencepiece_codec, simhash, substrings, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the machine's public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    """Production parameters of packing: byte-level BPE, windows of 2048, end id 1."""
    import public_tokenizers

    return packing.pack(docs, ranks_path=tokenizer_file("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, window=2048, end_id=1, specials=packing.added_tokens(tokenizer_file("byte_bpe_50k.json")))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), model_path=tokenizer_file("piece_bpe_32k.model"), check=True)
    return found.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), "round_trip")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), details=True)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50, factor=256)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"), radius=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_simhash, op2_quality, op3_packing, op4_sentencepiece, op5_substrings, op6_secrets, op7_language, op8_topk, op9_warc, op10_fingerprints)
    }


OP8_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


# Base32 of SHA-1: the digest's bits in fives
OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h),
b AS (SELECT *, list_aggregate(list_transform(string_split(d.h, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS bits FROM d JOIN f USING (h))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


def _op6_sql() -> str:
    """Gaps and matches in turn give the places of all matches."""
    rules = []
    for i, r in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        pattern = r.pattern.replace("'", "''")
        pieces = [f"regexp_extract_all(text, '(?s)(.*?)({pattern})', {g})" for g in (1, 2, 2 + r.group)]
        rules.append(f"SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, {r.least} AS least, {pieces[0]} AS gaps, {pieces[1]} AS hits, {pieces[2]} AS counted FROM t WHERE regexp_matches(text, '{pattern}')")
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(rules)}),
u AS (SELECT doc_id, ord, kind, least, unnest(gaps) AS gap, unnest(hits) AS hit, unnest(counted) AS counted, generate_subscripts(hits, 1) AS i FROM m),
s AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop FROM u),
k AS (SELECT doc_id, ord, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s WHERE length(counted) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (kind IN ({base})) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM k GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""


# CRC-32 of the id's digits, bit by bit; its remainder
_HELD = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 = 2"""

# Profiles of at most 300 n-grams, compared rank by rank; a shorter n-gram has the smaller key.
OP7_SQL = r"""
WITH t AS MATERIALIZED (SELECT doc_id, lang, text IS NULL OR NOT regexp_matches(text, '\p{L}') AS empty, regexp_replace(chr(1) || lower(coalesce(text, '')) || chr(1), '[^\p{L}]+', chr(1), 'g') AS s FROM documents),
l AS MATERIALIZED (SELECT doc_id, lang, empty, s, HELD AS held_out FROM t),
u AS MATERIALIZED (SELECT doc_id, unnest(c) AS x, unnest(c[2:]) AS y, unnest(c[3:]) AS z FROM (SELECT doc_id, string_split(s, '') AS c FROM l WHERE NOT empty)),
g AS MATERIALIZED (SELECT doc_id, 1 AS n, x AS gram, count(*) AS c FROM u WHERE x <> chr(1) GROUP BY 1, 3 UNION ALL SELECT doc_id, 2, x || y, count(*) FROM u WHERE y IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT doc_id, 3, x || y || z, count(*) FROM u WHERE z IS NOT NULL GROUP BY 1, 3),
own AS MATERIALIZED (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, n, gram) - 1 AS r FROM g QUALIFY r < 300),
p AS MATERIALIZED (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(c) DESC, n, gram) - 1 AS r FROM g JOIN l USING (doc_id) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, n, gram QUALIFY r < 300),
d AS (SELECT o.doc_id, x.lang, sum(coalesce(abs(o.r - p.r), 300)) AS apart, count(*) AS n FROM own o CROSS JOIN (SELECT DISTINCT lang FROM p) x LEFT JOIN p ON p.lang = x.lang AND p.gram = o.gram GROUP BY 1, 2),
b AS (SELECT doc_id, lang, apart, n FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY apart, lang) = 1)
SELECT l.doc_id, l.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1.0::DOUBLE - b.apart::DOUBLE / (300 * b.n), 0) AS score FROM l LEFT JOIN b USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_secrets": _op6_sql(), "op7_language": OP7_SQL.replace("HELD", _HELD), "op8_topk": OP8_SQL, "op9_warc": OP9_SQL}
