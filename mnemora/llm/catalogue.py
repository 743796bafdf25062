"""Registered queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import conversations, encoding, language, leakage, neardup, neighbours, packing, privacy, splitting
from mnemora.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# -- 3: conversations --------------------------------------------------------------------------------


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to drop."""
    t = [table(spark, sf_dir, n) for n in ("sessions", "messages", "role_aliases")]
    return conversations.conversations(*t).where(~F.col("kept")).select("thread_id")


@query
def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered messages of the conversations that are kept."""
    t = [table(spark, sf_dir, n) for n in ("sessions", "messages", "role_aliases")]
    return conversations.ordered_messages(*t)


_P3 = r"""
WITH m AS (
  SELECT DISTINCT id, nullif(regexp_replace(regexp_replace(thread_id, '^\s+|\s+$', '', 'g'), '^\w+://session/([^/]*).*$', '\1'), '') AS t,
    coalesce(sent_at, created_at) AS ts, a.role AS r,
    coalesce(regexp_matches(content, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]'), false) AS filled, content
  FROM messages LEFT JOIN role_aliases a ON a.alias = messages.role),
s AS (SELECT DISTINCT regexp_replace(thread_id, '^\s+|\s+$', '', 'g') AS t FROM sessions WHERE thread_id IS NOT NULL),
x AS (SELECT t, r, ts, id, filled FROM m WHERE t IS NOT NULL),
bad AS (SELECT DISTINCT t FROM x WHERE ts IS NULL OR r IS NULL OR NOT filled),
turns AS (SELECT t, r, lag(r) OVER w AS before, lead(r) OVER w AS after FROM x WHERE r <> 'system' OR r IS NULL WINDOW w AS (PARTITION BY t ORDER BY ts, id)),
wrong AS (SELECT DISTINCT t FROM turns WHERE (before IS NULL AND r <> 'user') OR (after IS NULL AND r <> 'assistant') OR before = r),
kept AS (SELECT t FROM s WHERE t IN (SELECT t FROM turns) AND t NOT IN (SELECT t FROM bad) AND t NOT IN (SELECT t FROM wrong))
"""
ORACLES["p3_found"] = _P3 + "SELECT t AS thread_id FROM (SELECT t FROM s UNION SELECT t FROM x) WHERE t NOT IN (SELECT t FROM kept)"
ORACLES["p3_conversations"] = _P3 + (
    "SELECT t AS thread_id, row_number() OVER (PARTITION BY t ORDER BY ts, id) AS turn_no, id AS message_id, r AS speaker, ts AS sent_at, content "
    "FROM m WHERE t IN (SELECT t FROM kept)"
)


# -- 4: oversized items ------------------------------------------------------------------------------


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of messages and memories as items."""
    each = [
        table(spark, sf_dir, n).select(F.lit(n).alias("table_name"), F.col("id").alias("record_id"), F.lit("content").alias("field_name"), F.col("content").alias("text"))
        for n in ("messages", "memories")
    ]
    return each[0].unionByName(each[1])


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items larger than their limit: those that were cut."""
    return p4_pieces(spark, sf_dir).where("piece_no = 2").select("table_name", "record_id").distinct()


@query
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized item."""
    return splitting.pieces(_items(spark, sf_dir), table(spark, sf_dir, "size_limits"))


ORACLES["p4_found"] = """
SELECT DISTINCT 'messages' AS table_name, id AS record_id FROM messages, size_limits l
WHERE l.table_name = 'messages' AND l.field_name = 'content' AND length(content) > l.max_size
UNION ALL
SELECT DISTINCT 'memories', id FROM memories, size_limits l
WHERE l.table_name = 'memories' AND l.field_name = 'content' AND strlen(content) > l.max_size
"""

# -- 8: leaked evaluation texts ----------------------------------------------------------------------


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items that they give away."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


@query
def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked span with its test item."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected documents without the leaked spans."""
    return leakage.without_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


ORACLES["p8_found"] = r"""
WITH e AS (SELECT item_id, regexp_replace(lower(t), '[^\p{L}\p{N}]', '', 'g') AS t
           FROM (SELECT item_id, unnest([question, answer, evidence]) AS t FROM eval_items)),
grams AS (SELECT DISTINCT item_id, substr(t, i, 50) AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - 48)) AS i FROM e WHERE length(t) >= 50)),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM documents),
windows AS (SELECT doc_id, substr(t, i, 50) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 48)) AS i FROM d WHERE length(t) >= 50))
SELECT DISTINCT doc_id, item_id FROM windows JOIN grams USING (g)
"""

# -- 9: wrong character encoding ---------------------------------------------------------------------


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with garbled text."""
    return encoding.garbled(table(spark, sf_dir, "documents")).select("doc_id")


@query
def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected documents with the encoding chains and the restored text."""
    return encoding.garbled(table(spark, sf_dir, "documents"))


# -- 5: near-duplicates ------------------------------------------------------------------------------


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of facts and memories as records."""
    each = [table(spark, sf_dir, n).select(F.lit(n).alias("table_name"), F.col(k).alias("record_id"), "content") for n, k in (("facts", "fact_id"), ("memories", "id"))]
    return each[0].unionByName(each[1])


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records whose contents are alike."""
    return neardup.record_pairs(_contents(spark, sf_dir)).select("table_name", "a_id", "b_id")


_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"
ORACLES["p5_found"] = rf"""
WITH r AS (SELECT DISTINCT table_name, record_id, norm FROM (
  SELECT 'facts' AS table_name, fact_id AS record_id, trim(regexp_replace(lower(content), '{_BLANK}', ' ', 'g'), ' ') AS norm FROM facts
  UNION ALL SELECT 'memories', id, trim(regexp_replace(lower(content), '{_BLANK}', ' ', 'g'), ' ') FROM memories)
  WHERE record_id IS NOT NULL AND length(norm) >= 4),
g AS (SELECT DISTINCT table_name, record_id, substr(norm, i, 4) AS gram FROM (SELECT *, unnest(range(1, length(norm) - 2)) AS i FROM r)),
n AS (SELECT table_name, record_id, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT a.table_name, a.record_id AS a_id, b.record_id AS b_id, count(*) AS shared FROM g a JOIN g b ON a.table_name = b.table_name AND a.gram = b.gram AND a.record_id < b.record_id GROUP BY ALL)
SELECT s.table_name, a_id, b_id FROM s JOIN n x ON x.table_name = s.table_name AND x.record_id = a_id JOIN n y ON y.table_name = s.table_name AND y.record_id = b_id
WHERE shared >= 0.7 * (x.n + y.n - shared)
"""


@query
def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its group and its number of links."""
    return neardup.groups(_contents(spark, sf_dir))


# -- 7: containers -----------------------------------------------------------------------------------


@query
def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or part of an oversized one, with its container."""
    capacity = table(spark, sf_dir, "size_limits").where("table_name = 'documents' AND unit = 'tokens'").first()["max_size"]
    return packing.bins(table(spark, sf_dir, "documents"), int(capacity))


# -- 2: most similar vectors -------------------------------------------------------------------------


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of memories of which one is among the ten nearest of the other."""
    return neighbours.pairs(neighbours.nearest(table(spark, sf_dir, "memories")))


@query
def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest memories of every memory."""
    return neighbours.nearest(table(spark, sf_dir, "memories"))


# -- 1: languages ------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of messages and query intents with their labels."""
    each = [
        table(spark, sf_dir, n).select(F.lit(n).alias("table_name"), F.col(k).alias("record_id"), F.col(t).alias("content"), F.col("lang").alias("label"))
        for n, k, t in (("messages", "id", "content"), ("query_intents", "query_id", "original_query"))
    ]
    return each[0].unionByName(each[1])


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose language label is missing or wrong or whose text mixes languages."""
    found = language.detect(_labelled(spark, sf_dir), table(spark, sf_dir, "documents"))
    return language.mislabelled(found, table(spark, sf_dir, "lang_aliases"))


@query
def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every single-language segment with its language and confidence."""
    found = language.detect(_labelled(spark, sf_dir), table(spark, sf_dir, "documents"))
    return found.select("table_name", "record_id", F.explode("segments").alias("s")).select("table_name", "record_id", "s.*").distinct()


# -- 6: personal information -------------------------------------------------------------------------


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the kinds of personal information that they hold."""
    return privacy.masked(table(spark, sf_dir, "messages")).select("message_id", F.explode("kinds").alias("pii_kind")).distinct()


@query
def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with personal information, each item replaced by a placeholder."""
    return privacy.masked(table(spark, sf_dir, "messages")).select("message_id", "text")
