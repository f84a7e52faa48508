"""Driver queries of the training-data operators, and their SQL where there is
one. Each runs its operator with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veridoc.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm import bpe

    return bpe.round_trip(
        read_table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm import tokenfile

    return tokenfile.round_trip(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2
    )


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm import decontaminate

    return decontaminate.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op3_decontaminate"] = f"""
WITH item AS (
  SELECT item_id, {_WORDS.format(text="text")} AS w FROM benchmark WHERE text IS NOT NULL
), gram AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n,
         array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS g
  FROM item, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS w FROM documents
), size AS (SELECT DISTINCT n FROM gram
), win AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM doc, size, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n
), hit AS (
  SELECT doc_id, item_id, i, win.n FROM win JOIN gram USING (n, g)
), word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(i, i + n)) AS r(p) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm import sketch

    return sketch.against_next(read_table(spark, sf_dir, "documents"))


#: The rules of the query.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm import urls

    return urls.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


# The rules alone: the tables' pages have neither canonical links nor
# redirects; those are tested against a brute-force version.
ORACLE_SQL["op9_url_filter"] = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rule(v, h, s) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fit AS (
  SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS v
  FROM p JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN fit USING (page_id)
"""


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm import jaccard

    return jaccard.join(read_table(spark, sf_dir, "documents"), words=4, percent=85)


ORACLE_SQL["op6_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(4, len(w)) - 1], ' ')) AS s
  FROM w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), k AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM k JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), b AS (SELECT x AS u, y AS v FROM e UNION ALL SELECT y, x FROM e
), reach AS (
  SELECT doc_id AS a, doc_id AS z FROM documents UNION SELECT a, v FROM reach JOIN b ON z = u
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(z) FROM reach WHERE a = w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm import substring

    return substring.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm import toxicity

    documents = read_table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, read_table(spark, sf_dir, "labels")))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm import warc

    return warc.round_trip(read_table(spark, sf_dir, "pages"), least=0).drop("url")


# Base 32 by hand: five bits of the digest at a time.
ORACLE_SQL["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
         array_to_string(list_transform(string_split(sha1(html), ''), lambda h: bin(('0x' || h)::INT + 16)[2:]), '') AS bits FROM p
), e AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[('0b' || bits[5 * i + 1 : 5 * i + 5])::INT + 1]), '') AS payload_digest FROM d
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM e
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm import html

    return html.extract(read_table(spark, sf_dir, "pages"))
