"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import audit, bpe, chunk_dedup, imatch, kdtree, line_runs, packing, simhash, token_counts, token_files, toxicity, warc, word_runs
from packetloom.llm.io import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary lies; the driver reads the file, tasks get its text."""
    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=1)


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.report(table(spark, sf_dir, "documents"))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"), tau=4, words=4)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=100)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.shard(table(spark, sf_dir, "documents"), shards=40)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.report(table(spark, sf_dir, "documents"), tails=True)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_packing, op3_imatch, op4_line_runs, op5_chunk_dedup, op6_simhash, op7_warc, op8_token_counts, op9_kdtree, op10_toxicity, op11_word_runs, op12_filter_audit, op13_token_files)
}

#: The shortest runs of lines with three words, forwards and backwards from each line; all but the first of equal ones go.
_OP4 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
c AS (SELECT *, len(regexp_extract_all(line, '\S+')) AS w, sum(len(regexp_extract_all(line, '\S+'))) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l),
ahead AS (SELECT a.doc_id, a.pos AS i, min(b.pos) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto >= a.upto - a.w + 3 GROUP BY ALL),
behind AS (SELECT b.doc_id, max(a.pos) AS i, b.pos AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto >= a.upto - a.w + 3 GROUP BY b.doc_id, b.pos),
runs AS (SELECT doc_id, i, j, ls[i + 1 : j + 1] AS run FROM (FROM ahead UNION SELECT doc_id, i, j FROM behind) JOIN d USING (doc_id)),
later AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS copy FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS pos FROM later WHERE copy > 1),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY l.doc_id),
lost AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS deleted FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.ls) AS n_lines, coalesce(lost.n, 0) AS n_deleted, coalesce(deleted, '') AS deleted, coalesce(kept.text, '') AS text
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

#: The classes of white space are ASCII; of equal texts the longest original stays, then the smallest id.
_OP5 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND least < page_id THEN least END AS refers_to
FROM q
"""

#: Filters by definition, document by document, in every order.
_OP12 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, [strpos('ABCDE', filter_order[k]) FOR k IN range(1, step + 1)] AS upto FROM (FROM o WHERE length(filter_order) = 5), (SELECT unnest(range(1, 6)) AS step)),
j AS (SELECT part, filter_order, step, n, good, toxic, fails[upto[-1]] AS here, list_bool_or([fails[k] FOR k IN upto[:-2]] || [false]) AS gone, list_sum([CAST(x AS INT) FOR x IN fails]) AS failing, upto[-1] AS filter
  FROM m, s),
r AS (SELECT part, filter_order, step, filter,
    sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN here AND failing = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""

ORACLE_SQL: dict[str, str] = {"op12_filter_audit": _OP12, "op4_line_runs": _OP4, "op5_chunk_dedup": _OP5, "op7_warc": _OP7}
