"""Registered queries of the core and their DuckDB equivalents. Every query runs over its whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import text as t
from mnemora.functions import uri as u
from mnemora.functions.vectors import cosine
from mnemora.operators import decay, evaluate, layers, maintenance, merge, search, sessions, tree
from mnemora.operators.filters import MemoryFilter
from mnemora.sources.tables import table
from mnemora.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "layered_search"
AS_OF = "2026-01-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- shared views ------------------------------------------------------------------------------------


def _memories(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Memories once each: redelivered rows differ in their arrival only."""
    return table(spark, sf_dir, "memories").select("id", *columns).distinct()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "uri", "text", F.octet_length("text").cast("long").alias("size"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "query_intents").where("original_query IS NOT NULL").select("query_id", F.col("original_query").alias("q")).distinct()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("key"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "value", "props")


_SEG = r"list_filter(string_split(regexp_extract({0}, '^\w+://([^?]*)', 1), '/'), lambda x: x <> '')"

# -- vector search -----------------------------------------------------------------------------------

_COS = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
"""


def _queries(e: DataFrame) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 100."""
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_COS + "SELECT query_id, vec_id, score FROM r WHERE n <= 10")
def knn_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.top_k(_queries(e), e, 10)


@query(_COS + "SELECT query_id, vec_id, score FROM r WHERE n <= 10 AND score >= 0.25")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.top_k(_queries(e), e, 10, 0.25)


_LAYERS = """
WITH e AS (SELECT vec_id, vec_id // 4 AS dir, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT vec_id, dir, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM e),
l0 AS (SELECT dir, list(a ORDER BY i) AS e FROM (SELECT dir, i, avg(x) AS a FROM x GROUP BY ALL) GROUP BY dir),
l1 AS (SELECT dir, list(a ORDER BY i) AS e FROM (SELECT dir, i, avg(x) AS a FROM x WHERE vec_id % 4 < 2 GROUP BY ALL) GROUP BY dir),
q AS (SELECT vec_id AS query_id, e FROM e WHERE vec_id % 100 = 0),
h0 AS (SELECT * FROM (SELECT query_id, dir, round(list_cosine_similarity(q.e, l0.e), 6) AS s0, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.e, l0.e), 6) DESC, dir) AS n FROM q, l0) WHERE n <= 30),
h AS (SELECT query_id, h0.dir, s0, coalesce(round(list_cosine_similarity(q.e, l1.e), 6), 0.8 * s0) AS s1 FROM h0 JOIN q USING (query_id) LEFT JOIN l1 ON l1.dir = h0.dir WHERE s0 >= {t0}),
m AS (SELECT query_id, vec_id, s0, s1, round(list_cosine_similarity(q.e, e.e), 6) AS s2 FROM h JOIN e USING (dir) JOIN q USING (query_id) WHERE s0 >= {t} * 0.5 OR s1 >= {t} * 0.5),
f AS (SELECT query_id, vec_id, round(s0 * {w0} + s1 * {w1} + s2 * {w2}, 6) AS score FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM f WHERE score >= {t})
SELECT query_id, vec_id, score FROM g WHERE n <= 10
"""


def _layered(spark: SparkSession, sf_dir: str, intent: str, threshold: float) -> DataFrame:
    """Layers from the vector table: a directory of four rows, its mean as L0, the mean of the first two as L1."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 4).alias("dir"), "embedding")
    q = _queries(e)
    _, w0, w1, w2, t0 = next(r for r in search.INTENT_RULES if r[0] == intent)
    l0 = search.centroids(e).withColumnRenamed("dir", "vec_id")
    l1 = search.centroids(e.where("vec_id % 4 < 2")).withColumnRenamed("dir", "vec_id")
    hits = search.top_k(q, l0, 30).select("query_id", F.col("vec_id").alias("dir"), F.col("score").alias("score0"))
    asked = hits.join(q.select("query_id", F.col("embedding").alias("qe")), "query_id")
    second = asked.join(l1.select(F.col("vec_id").alias("dir"), F.col("embedding").alias("e1")), "dir").select("query_id", "dir", F.round(cosine(F.col("qe"), F.col("e1")), 6).alias("score1"))
    third = asked.join(e.select("dir", "vec_id", F.col("embedding").alias("e2")), "dir").select("query_id", "dir", "vec_id", F.round(cosine(F.col("qe"), F.col("e2")), 6).alias("score2"))
    return search.layered(hits, second, third, (w0, w1, w2), t0, threshold, 10)


@query(_LAYERS.format(w0=0.15, w1=0.25, w2=0.6, t0=0.32, t=0.25))
def layered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layered(spark, sf_dir, "factual", 0.25)


@query(_LAYERS.format(w0=0.1, w1=0.2, w2=0.7, t0=0.28, t=0.5))
def layered_search_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layered(spark, sf_dir, "entity_lookup", 0.5)


# -- filters -----------------------------------------------------------------------------------------


@query("SELECT DISTINCT id FROM memories WHERE importance_score >= 0.25 AND importance_score < 0.75")
def filter_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = MemoryFilter(min_importance=0.25, max_importance=0.75)
    return table(spark, sf_dir, "memories").where(f.column()).select("id").distinct()


@query("SELECT DISTINCT id FROM memories WHERE list_contains(topics, 'topic_000') AND layer = 'L2'")
def filter_topics_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memories").where(MemoryFilter(topics=("topic_000",), layer="L2").column()).select("id").distinct()


@query("SELECT DISTINCT id FROM memories WHERE date_trunc('millisecond', created_at) >= TIMESTAMPTZ '2025-04-01 00:00:00+00' AND date_trunc('millisecond', created_at) <= TIMESTAMPTZ '2025-09-30 23:59:59+00'")
def filter_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc = dt.timezone.utc
    f = MemoryFilter(created_after=dt.datetime(2025, 4, 1, tzinfo=utc), created_before=dt.datetime(2025, 9, 30, 23, 59, 59, tzinfo=utc))
    return table(spark, sf_dir, "memories").where(f.column()).select("id").distinct()


@query("SELECT DISTINCT id FROM memories WHERE regexp_matches(uri, '^\\w+://user/') OR uri IS NULL")
def filter_prefix_keep_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "memories")
    scheme = m.where("uri IS NOT NULL").select(F.regexp_extract("uri", r"^(\w+://)", 1)).first()[0]  # one scheme for all
    return m.where(MemoryFilter(uri_prefix=scheme + "user/", keep_null_uri=True).column()).select("id").distinct()


@query("SELECT DISTINCT id FROM memories WHERE coalesce(contains(map_extract_value(custom, 'lang'), 'en'), false)")
def filter_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memories").where(MemoryFilter(custom={"lang": "en"}).column()).select("id").distinct()


# -- URIs --------------------------------------------------------------------------------------------


@query(
    f"""WITH s AS (SELECT DISTINCT uri, {_SEG.format('uri')} AS s FROM (SELECT uri FROM memories UNION ALL SELECT uri FROM documents) WHERE uri IS NOT NULL)
SELECT uri, s[1] AS dimension, s[2] AS category,
  CASE WHEN len(s) > 3 OR (len(s) = 3 AND NOT contains(s[3], '.')) THEN s[3] END AS subcategory,
  CASE WHEN len(s) > 3 THEN array_to_string(s[4:], '/') WHEN len(s) = 3 AND contains(s[3], '.') THEN s[3] END AS resource,
  coalesce(s[1] IN ('resources', 'user', 'agent', 'session'), false) AS valid FROM s"""
)
def uri_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "memories").select("uri").unionByName(table(spark, sf_dir, "documents").select("uri")).where("uri IS NOT NULL").distinct()
    return both.withColumn("p", u.parse(F.col("uri"))).select("uri", "p.*", u.is_valid(F.col("uri")).alias("valid"))


@query(
    f"""WITH s AS (SELECT DISTINCT uri, {_SEG.format('uri')} AS s FROM memories WHERE uri IS NOT NULL)
SELECT uri, s[1] AS scope, s[2] AS owner_id, regexp_replace(s[-1], '\\.md$', '') AS memory_id FROM s WHERE len(s) >= 3"""
)
def uri_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "memories").select("uri").where("uri IS NOT NULL").distinct()
    return m.withColumn("o", u.owner(F.col("uri"))).where("o IS NOT NULL").select("uri", "o.*")


@query(
    r"""SELECT DISTINCT uri, regexp_replace(uri, '/\.(abstract|overview)\.md$', '') AS canonical, regexp_replace(uri, '/[^/]*$', '') AS parent,
  CASE WHEN ends_with(uri, '.md') THEN regexp_replace(uri, '/[^/]*$', '') ELSE uri END || '/.abstract.md' AS l0_uri,
  ends_with(uri, '.md') AND NOT regexp_matches(uri, '/\.(abstract|overview)\.md$') AS leaf FROM memories WHERE uri IS NOT NULL"""
)
def uri_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("uri")
    return table(spark, sf_dir, "memories").where("uri IS NOT NULL").select("uri", u.canonical(c).alias("canonical"), u.parent(c).alias("parent"), u.layer(c, "L0").alias("l0_uri"), u.is_leaf(c).alias("leaf")).distinct()


@query(
    r"""SELECT DISTINCT thread_id, CASE WHEN thread_id IS NULL THEN 'mem://session'
  WHEN regexp_matches(thread_id, '^\w+://(resources|user|agent|session)(/|$)') THEN 'mem://' || regexp_extract(thread_id, '^\w+://(?s:(.*))$', 1)
  WHEN regexp_matches(thread_id, '^\w+://(threads|agents|users|global)(/|$)') THEN 'mem://session' || regexp_replace(regexp_extract(thread_id, '^\w+://(?s:(.*))$', 1), '^[^/]*', '')
  WHEN regexp_matches(thread_id, '^\w+://') THEN 'mem://session' ELSE 'mem://session/' || regexp_replace(thread_id, '^/+', '') END AS scope FROM messages"""
)
def scope_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages").select("thread_id", u.normal_scope(F.col("thread_id")).alias("scope")).distinct()


# -- query understanding and text --------------------------------------------------------------------

_KEYS = r"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(q, '[^\p{L}\p{N}+#]+'), lambda x: lower(x)), lambda x: length(x) > 2 AND x NOT IN (STOP))))".replace("STOP", ", ".join(f"'{w}'" for w in t.STOP_WORDS))
_ENTS = r"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(q, '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$', '', 'g')), lambda x: length(x) >= 2 AND regexp_matches(x, '^\p{Lu}'))))"
_ASKED = "SELECT DISTINCT query_id, original_query AS q FROM query_intents WHERE original_query IS NOT NULL"
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{'|'.join(w)}') THEN '{k}'" for k, w in t.INTENT_WORDS) + " ELSE 'factual' END"
_TERMS = "CASE k " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in w)}]" for k, w in t.INTENT_TERMS.items()) + " END"


@query(f"SELECT query_id, array_to_string({_KEYS}, ' ') AS keywords, array_to_string({_ENTS}, ' ') AS entities, {_INTENT} AS intent FROM ({_ASKED})")
def query_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("q")
    return _asked(spark, sf_dir).select("query_id", F.array_join(t.keywords(c), " ").alias("keywords"), F.array_join(t.entities(c), " ").alias("entities"), t.intent(c).alias("intent"))


@query(
    f"SELECT query_id, left(array_to_string(list_sort(list_distinct(list_concat([q], e, w[1:6], {_TERMS}))), ' '), 200) AS rewritten "
    f"FROM (SELECT query_id, q, {_KEYS} AS w, {_ENTS} AS e, {_INTENT} AS k FROM ({_ASKED}))"
)
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("query_id", t.rewritten(F.col("q")).alias("rewritten"))


@query(
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_tokens, strlen(text) // 3 AS estimate,
  length(text) AS n_chars, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL"""
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", t.token_count(c).alias("n_tokens"), t.token_estimate(c).alias("estimate"), F.char_length(c).cast("long").alias("n_chars"), F.octet_length(c).cast("long").alias("n_bytes"))


_FIRST = r"list_filter(string_split(content, chr(10)), lambda x: NOT (starts_with(x, '**') OR starts_with(x, '---')))"


@query(f"SELECT DISTINCT id, sha256(CASE WHEN length(j) > 200 THEN left(j, 200) || '...' ELSE j END) AS summary_hash FROM (SELECT id, trim(array_to_string({_FIRST}, ' '), ' ') AS j FROM memories WHERE content IS NOT NULL)")
def content_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memories").where("content IS NOT NULL").select("id", F.sha2(t.content_summary(F.col("content")), 256).alias("summary_hash")).distinct()


@query(
    r"""WITH x AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, t, regexp_extract(left(t, 2000), '(?s)^(.*[。.?!！？])', 1) AS a, regexp_extract(left(t, 6000), '(?s)^(.*)\n\n', 1) AS o FROM x)
SELECT doc_id, sha256(CASE WHEN length(t) <= 2000 THEN t WHEN a <> '' THEN a ELSE left(t, 1997) || '...' END) AS abstract_hash,
  length(CASE WHEN length(t) <= 6000 THEN t WHEN o <> '' THEN o || chr(10) || chr(10) || '[...]' ELSE left(t, 6000) || chr(10) || chr(10) || '[...]' END) AS overview_length FROM y"""
)
def layer_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(t.limited_abstract(c), 256).alias("abstract_hash"), F.char_length(t.limited_overview(c)).cast("long").alias("overview_length"))


@query(
    r"""SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (starts_with(x, '<!-- source-hash:') OR starts_with(x, '**Added**:'))), chr(10))) AS lines_hash,
  sha256(regexp_replace(regexp_replace(text, '(?s)(\n\n)?\*\*Added\*\*:.*$', ''), '^\s+|\s+$', '', 'g')) AS head_hash FROM documents WHERE text IS NOT NULL"""
)
def metadata_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(t.without_metadata_lines(c), 256).alias("lines_hash"), F.sha2(t.without_added(c), 256).alias("head_hash"))


@query(
    r"""WITH f AS (SELECT fact_id, max_by(struct_pack(content := content, entities := entities), extracted_at) AS x FROM facts WHERE content IS NOT NULL GROUP BY fact_id),
y AS (SELECT fact_id, x.content AS c, coalesce(x.entities[1], '') AS q FROM f)
SELECT fact_id, sha256(CASE WHEN q <> '' AND strpos(lower(c), lower(q)) > 0 THEN CASE WHEN strpos(lower(c), lower(q)) > 101 THEN '...' ELSE '' END
  || substr(c, greatest(strpos(lower(c), lower(q)) - 100, 1), strpos(lower(c), lower(q)) - greatest(strpos(lower(c), lower(q)) - 100, 1) + length(q) + 100)
  WHEN length(c) > 200 THEN left(c, 200) || '...' ELSE c END) AS snippet_hash FROM y"""
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippet of each fact around its first entity."""
    f = merge.latest(table(spark, sf_dir, "facts").where("content IS NOT NULL").select("fact_id", "content", "entities", "extracted_at"), ["fact_id"], [F.col("extracted_at")])
    return f.select("fact_id", F.sha2(t.snippet(F.col("content"), F.coalesce(F.get("entities", 0), F.lit(""))), 256).alias("snippet_hash"))


# -- the tree ----------------------------------------------------------------------------------------

_ABOVE = rf"""WITH f AS (SELECT uri, strlen(text) AS size, {_SEG.format('uri')} AS s, regexp_extract(uri, '^(\w+://)', 1) AS r FROM documents WHERE text IS NOT NULL),
a AS (SELECT uri, size, r || array_to_string(s[1:n], '/') AS dir FROM (SELECT *, unnest(range(1, len(s))) AS n FROM f))
"""


@query(
    _ABOVE
    + r"""SELECT regexp_replace(uri, '/[^/]*$', '') AS dir, uri AS child, false AS is_directory, 0::BIGINT AS child_count FROM f WHERE NOT starts_with(regexp_extract(uri, '([^/]*)$', 1), '.')
UNION ALL SELECT regexp_replace(d, '/[^/]*$', ''), d, true, coalesce(n, 0) FROM (SELECT DISTINCT dir AS d FROM a WHERE regexp_matches(dir, '^\w+://[^/]+/')) LEFT JOIN
  (SELECT dir AS d, count(DISTINCT child) AS n FROM (SELECT regexp_replace(uri, '/[^/]*$', '') AS dir, uri AS child FROM f WHERE NOT starts_with(regexp_extract(uri, '([^/]*)$', 1), '.') UNION ALL SELECT regexp_replace(dir, '/[^/]*$', ''), dir FROM a) GROUP BY 1) USING (d)"""
)
def dir_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.listing(_documents(spark, sf_dir).select("uri"))


@query(_ABOVE + "SELECT dir, count(*) AS n_files, sum(size)::BIGINT AS n_bytes FROM a GROUP BY dir")
def dir_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.stats(_documents(spark, sf_dir))


_COMBINED = r"""WITH p AS (SELECT regexp_replace(uri, '/[^/]*$', '') AS dir, regexp_extract(uri, '([^/]*)$', 1) AS name,
  chr(10) || chr(10) || '=== ' || regexp_extract(uri, '([^/]*)$', 1) || ' ===' || chr(10) || chr(10)
  || array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (starts_with(x, '<!-- source-hash:') OR starts_with(x, '**Added**:'))), chr(10)) AS part FROM documents WHERE text IS NOT NULL),
c AS (SELECT dir, string_agg(part, '' ORDER BY name) AS c FROM p WHERE ends_with(name, '.md') OR ends_with(name, '.txt') GROUP BY dir),
d AS (SELECT dir, CASE WHEN length(c) > 10000 THEN left(c, 10000) || chr(10) || chr(10) || '[...]' ELSE c END AS content FROM c)
"""


@query(_COMBINED + "SELECT dir, length(content) AS n_chars, sha256(content) AS source_hash FROM d")
def aggregate_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tree.combined(_documents(spark, sf_dir).select("uri", "text"))
    return c.select("dir", F.char_length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("source_hash"))


@query(_COMBINED + "SELECT dir, sha256(content) AS source_hash FROM d WHERE NOT (length(content) % 2 = 0)")
def dirty_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories to sum up again, where the stored hashes are right for contents of even length only."""
    c = tree.combined(_documents(spark, sf_dir).select("uri", "text"))
    stored = c.select("dir", F.when(F.char_length("content") % 2 == 0, F.sha2("content", 256)).otherwise("stale").alias("source_hash"))
    return tree.dirty(c, stored)


@query(
    r"""WITH m AS (SELECT DISTINCT id, CASE WHEN regexp_matches(uri, '/\.(abstract|overview)\.md$') THEN regexp_replace(uri, '/\.(abstract|overview)\.md$', '')
  WHEN ends_with(uri, '.md') THEN regexp_replace(uri, '/[^/]*$', '') ELSE uri END AS dir, coalesce(layer, 'L2') AS l FROM memories WHERE uri IS NOT NULL)
SELECT dir, bool_or(l = 'L0') AS has_l0, bool_or(l = 'L1') AS has_l1, count(*) FILTER (l = 'L2') AS n_l2 FROM m GROUP BY dir"""
)
def layer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.coverage(_memories(spark, sf_dir, "uri", "layer"))


@query(
    _ABOVE
    + r""", g AS (SELECT a.dir, len(list_filter(string_split(regexp_extract(a.dir, '^\w+://([^?]*)', 1), '/'), lambda x: x <> '')) AS depth, contains(d.text, 'the spare bicycle') AS hit
  FROM a JOIN documents d ON d.uri = a.uri WHERE d.text IS NOT NULL)
SELECT dir, depth, count(*) AS n_files, count(*) FILTER (hit) AS n_hits, CASE WHEN bool_or(hit) THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END AS relevance FROM g WHERE depth <= 3 GROUP BY dir, depth"""
)
def explore_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.explore(_documents(spark, sf_dir).select("uri", "text"), "the spare bicycle")


# -- sessions and timelines --------------------------------------------------------------------------


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("thread_id", r"^\s+|\s+$", ""), r"^\w+://session/([^/]*).*$", "$1")
    m = table(spark, sf_dir, "messages").where("thread_id IS NOT NULL").select(plain.alias("thread_id"), "id", F.coalesce("sent_at", "created_at").alias("at"), "content").distinct()
    return m


_SENT = r"""WITH m AS (SELECT DISTINCT regexp_replace(regexp_replace(thread_id, '^\s+|\s+$', '', 'g'), '^\w+://session/([^/]*).*$', '\1') AS thread_id, id, coalesce(sent_at, created_at) AS sent, content FROM messages WHERE thread_id IS NOT NULL)
"""


@query(
    _SENT
    + """SELECT thread_id, strftime(sent, '%Y-%m') AS month, strftime(sent, '%d') AS day, count(*) AS n_messages, min(sent) AS first_at, max(sent) AS last_at FROM m WHERE sent IS NOT NULL
GROUP BY GROUPING SETS ((thread_id), (thread_id, strftime(sent, '%Y-%m')), (thread_id, strftime(sent, '%Y-%m'), strftime(sent, '%d')))"""
)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.timeline(_sent(spark, sf_dir))


@query(_SENT + "SELECT id, 'mem://session/' || thread_id || '/timeline/' || strftime(sent, '%Y-%m/%d/%H_%M_%S') || '_' || left(id, 8) || '.md' AS uri FROM m WHERE sent IS NOT NULL")
def message_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sent(spark, sf_dir).where("at IS NOT NULL").select("id", sessions.path(F.col("thread_id"), F.col("id"), F.col("at")).alias("uri"))


@query(
    r"""SELECT DISTINCT id, a.role AS role, date_trunc('second', sent_at) AS "timestamp",
  sha256(array_to_string(list_filter(string_split(regexp_extract(chr(10) || content || chr(10), '(?s)^(.*?)(?:\n## |$)', 1), chr(10)), lambda x: trim(x, ' ') <> ''), chr(10))) AS content_hash
FROM messages JOIN role_aliases a ON a.alias = messages.role WHERE sent_at IS NOT NULL AND content IS NOT NULL
AND array_to_string(list_filter(string_split(regexp_extract(chr(10) || content || chr(10), '(?s)^(.*?)(?:\n## |$)', 1), chr(10)), lambda x: trim(x, ' ') <> ''), chr(10)) <> ''"""
)
def message_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages rendered as markdown and read back."""
    roles = F.broadcast(table(spark, sf_dir, "role_aliases").select(F.col("alias").alias("role"), F.col("role").alias("known")))  # fixed and small
    m = table(spark, sf_dir, "messages").join(roles, "role").where("sent_at IS NOT NULL AND content IS NOT NULL")
    p = m.select(sessions.parsed(sessions.rendered(F.col("known"), F.col("id"), F.col("sent_at"), F.col("content"))).alias("p")).where("p IS NOT NULL")
    return p.select("p.id", "p.role", "p.timestamp", F.sha2("p.content", 256).alias("content_hash")).distinct()


@query(
    """WITH s AS (SELECT thread_id, max_by(struct_pack(status := status, user_id := user_id, participants := participants), (updated_at, message_count, status)) AS x FROM sessions GROUP BY thread_id)
SELECT x.user_id AS user_id, x.status AS status, count(*) AS n_sessions, sum(len(coalesce(x.participants, [])))::BIGINT AS n_participants FROM s GROUP BY ROLLUP (x.user_id, x.status)"""
)
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current sessions and participants by user and status, with totals."""
    s = sessions.latest_sessions(table(spark, sf_dir, "sessions").select("thread_id", "status", "user_id", "participants", "updated_at", "message_count"))
    return s.rollup("user_id", "status").agg(F.count("*").alias("n_sessions"), F.sum(F.when(F.col("participants").isNull(), 0).otherwise(F.size("participants"))).alias("n_participants"))


# -- index merge -------------------------------------------------------------------------------------

_MERGE = r"""WITH x AS (SELECT DISTINCT fact_id, coalesce(thread_id, '') AS session, category AS memory_type, lower(coalesce(entities[1], 'general')) AS key_name, content, importance::DOUBLE AS confidence, min(extracted_at) AS first_at
  FROM facts WHERE content IS NOT NULL AND category IS NOT NULL GROUP BY ALL),
l AS (SELECT memory_type, key_name, max_by(struct_pack(h := sha256(content), s := content, c := confidence), (first_at, fact_id)) AS x, count(*) AS n_items, count(DISTINCT session) AS n_sessions FROM x GROUP BY ALL),
i AS (SELECT memory_type, key_name, max_by(struct_pack(h := content_hash, s := content_summary, c := confidence), (updated_at, id)) AS o FROM memory_index GROUP BY ALL),
j AS (SELECT l.*, o, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(o.s, '')), '\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(x.s), '\s+'), lambda w: w <> '')) AS b
  FROM l LEFT JOIN i USING (memory_type, key_name))
SELECT 'all' AS owner_id, memory_type, key_name, CASE WHEN o IS NULL THEN 'create' WHEN x.c > o.c + 0.1 OR o.h IS DISTINCT FROM x.h OR coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0) < 0.9 THEN 'update' ELSE 'keep' END AS action,
  round(x.c, 6) AS confidence, n_items, n_sessions FROM j"""


@query(_MERGE)
def merge_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as extracted items, merged by type and first entity."""
    index, items = _merge_input(spark, sf_dir)
    return merge.merge_actions(index, items).withColumn("confidence", F.round("confidence", 6))


def _merge_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The index with each key once, and the facts as extracted items of type and first entity."""
    f = table(spark, sf_dir, "facts").where("content IS NOT NULL AND category IS NOT NULL")
    x = f.groupBy("fact_id", F.coalesce("thread_id", F.lit("")).alias("session"), F.col("category").alias("memory_type"), F.lower(F.coalesce(F.get("entities", 0), F.lit("general"))).alias("key_name"), "content", F.col("importance").cast("double").alias("confidence")).agg(F.min("extracted_at").alias("at"))
    items = x.select(F.lit("all").alias("owner_id"), "memory_type", "key_name", F.sha2("content", 256).alias("content_hash"), F.col("content").alias("summary"), "confidence", "session", F.struct("at", "fact_id").alias("ordinal"))
    i = table(spark, sf_dir, "memory_index").select(F.lit("all").alias("owner_id"), "memory_type", "key_name", "content_hash", "content_summary", "confidence", "created_at", "updated_at", "access_count", "id")
    return merge.latest(i.withColumn("u", F.col("updated_at")), list(merge.KEY), [F.col("u"), F.col("id")]).drop("u", "id"), items


_ITEMS = _MERGE[: _MERGE.index("i AS (SELECT")]


@query(
    _ITEMS
    + r"""i AS (SELECT memory_type, key_name, max_by(struct_pack(h := content_hash, s := content_summary, c := confidence, made := created_at, upd := updated_at, n := access_count), (updated_at, id)) AS o FROM memory_index GROUP BY ALL),
j AS (SELECT coalesce(l.memory_type, i.memory_type) AS memory_type, coalesce(l.key_name, i.key_name) AS key_name, l.x AS x, o,
  list_distinct(list_filter(regexp_split_to_array(lower(coalesce(o.s, '')), '\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(x.s), '\s+'), lambda w: w <> '')) AS b
  FROM l FULL JOIN i ON l.memory_type = i.memory_type AND l.key_name = i.key_name),
k AS (SELECT *, CASE WHEN x IS NULL THEN 'none' WHEN o IS NULL THEN 'create' WHEN x.c > o.c + 0.1 OR o.h IS DISTINCT FROM x.h OR coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0) < 0.9 THEN 'update' ELSE 'keep' END AS change_type FROM j)
SELECT 'all' AS owner_id, memory_type, key_name, CASE WHEN change_type IN ('create', 'update') THEN x.h ELSE o.h END AS content_hash, CASE WHEN change_type IN ('create', 'update') THEN x.s ELSE o.s END AS content_summary,
  round(CASE WHEN change_type IN ('create', 'update') THEN x.c ELSE o.c END, 6) AS confidence, CASE WHEN change_type = 'create' THEN TIMESTAMPTZ '2026-01-01 00:00:00+00' ELSE o.made END AS created_at,
  CASE WHEN change_type IN ('create', 'update') THEN TIMESTAMPTZ '2026-01-01 00:00:00+00' ELSE o.upd END AS updated_at, coalesce(o.n, 0)::BIGINT AS access_count, change_type FROM k"""
)
def merged_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after the facts: created and updated rows with their effects."""
    index, items = _merge_input(spark, sf_dir)
    return merge.applied(index, items, F.lit(AS_OF).cast("timestamp")).withColumn("confidence", F.round("confidence", 6))


@query(_ITEMS.rstrip().rstrip(",") + """
SELECT session, count(DISTINCT (memory_type, key_name)) AS n_keys FROM x WHERE session <> '' GROUP BY session""")
def session_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys each session contributed to."""
    _, items = _merge_input(spark, sf_dir)
    return merge.links(items).where("session <> ''").groupBy("session").agg(F.count("*").alias("n_keys"))


@query("SELECT id FROM memory_index WHERE NOT coalesce(list_contains(source_sessions, (SELECT min(thread_id) FROM sessions)), false)")
def deleted_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index without what the first session contributed to."""
    first = table(spark, sf_dir, "sessions").agg(F.min("thread_id")).first()[0]
    return merge.without_session(table(spark, sf_dir, "memory_index"), first).select("id")


@query(
    """WITH n AS (SELECT user_id, count(*) AS n, max(ts) AS seen FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT id, greatest(last_accessed, seen::TIMESTAMPTZ) AS last_accessed, coalesce(access_count, 0) + coalesce(n, 0) AS access_count,
  coalesce(consolidation_count, 0) + (coalesce(access_count, 0) + coalesce(n, 0)) // 5 - coalesce(access_count, 0) // 5 AS consolidation_count
FROM memory_index LEFT JOIN n ON 'u' || lpad(n.user_id::VARCHAR, 5, '0') = memory_index.owner_id"""
)
def record_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of accesses: each view of a user reaches all of the user's memories."""
    i = table(spark, sf_dir, "memory_index")
    views = _events(spark, sf_dir).where("key = 'view'").select(F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("id"), F.col("ts").alias("at"))
    by_owner = i.select(F.col("owner_id").alias("id"), F.col("id").alias("memory"), "last_accessed", "access_count", "consolidation_count")
    seen = views.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    hits = by_owner.join(seen, "id").select(F.col("memory").alias("id"), "n", "at")
    return merge.record_access(i.select("id", "last_accessed", "access_count", "consolidation_count"), hits)


@query(
    """WITH x AS (SELECT DISTINCT unnest(source_sessions) AS session, id, memory_type, confidence FROM memory_index)
SELECT session, count(*) AS n_memories, count(DISTINCT memory_type) AS n_types, round(avg(confidence), 6) AS mean_confidence FROM x GROUP BY session"""
)
def session_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.by_session(table(spark, sf_dir, "memory_index"))


# -- forgetting --------------------------------------------------------------------------------------

_DECAY = f"""WITH s AS (SELECT id, owner_id, coalesce(archived, false) AS archived, round(greatest(least(coalesce(confidence, 0) * exp(-0.1 *
  (greatest(epoch(TIMESTAMPTZ '{AS_OF}+00')::BIGINT - floor(epoch(coalesce(last_accessed, TIMESTAMPTZ '{AS_OF}+00')))::BIGINT, 0) / 86400.0) / (1 + 0.2 * coalesce(consolidation_count, 0))), 1), 0), 6) AS strength FROM memory_index),
a AS (SELECT *, CASE WHEN archived AND strength < 0.02 THEN 'delete' WHEN NOT archived AND strength < 0.1 THEN 'archive' ELSE 'keep' END AS action FROM s)
"""


@query(_DECAY + "SELECT id, owner_id, strength, archived, action FROM a")
def memory_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.actions(table(spark, sf_dir, "memory_index"), AS_OF)


@query(_DECAY + "SELECT owner_id, count(*) FILTER (action = 'archive') AS n_archive, count(*) FILTER (action = 'delete') AS n_delete, count(*) AS n_memories FROM a GROUP BY owner_id")
def cleanup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = decay.actions(table(spark, sf_dir, "memory_index"), AS_OF)
    return a.groupBy("owner_id").agg(F.count_if(F.col("action") == "archive").alias("n_archive"), F.count_if(F.col("action") == "delete").alias("n_delete"), F.count("*").alias("n_memories"))


# -- maintenance -------------------------------------------------------------------------------------

_TAIL = r"regexp_extract(uri, '^\w+://[^/]+/[^/]+/(.*)$', 1)"


@query(f"SELECT DISTINCT id, uri FROM memories WHERE uri IS NOT NULL AND uri <> '' AND {_TAIL} NOT IN (SELECT file_path FROM memory_index WHERE file_path IS NOT NULL)")
def prune_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose file the index doesn't know; null and empty URIs are left alone."""
    m = _memories(spark, sf_dir, "uri").where("uri IS NOT NULL AND uri <> ''").withColumn("file_path", F.regexp_extract("uri", r"^\w+://[^/]+/[^/]+/(.*)$", 1))
    return m.join(table(spark, sf_dir, "memory_index").where("file_path IS NOT NULL").select("file_path"), "file_path", "left_anti").select("id", "uri")


@query(f"SELECT id, file_path FROM memory_index WHERE file_path NOT IN (SELECT {_TAIL} FROM memories WHERE uri IS NOT NULL)")
def index_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries without a vector."""
    held = _memories(spark, sf_dir, "uri").where("uri IS NOT NULL").select(F.regexp_extract("uri", r"^\w+://[^/]+/[^/]+/(.*)$", 1).alias("file_path"))
    return table(spark, sf_dir, "memory_index").where("file_path IS NOT NULL").join(held, "file_path", "left_anti").select("id", "file_path")


@query("SELECT coalesce(layer, 'L2') AS layer, count(*) AS n_points, count(*) FILTER (uri IS NULL) AS n_no_uri, count(*) FILTER (content IS NULL) AS n_no_content FROM (SELECT DISTINCT id, layer, uri, content FROM memories) GROUP BY 1")
def vector_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _memories(spark, sf_dir, "layer", "uri", "content")
    return m.groupBy(F.coalesce("layer", F.lit("L2")).alias("layer")).agg(F.count("*").alias("n_points"), F.count_if(F.col("uri").isNull()).alias("n_no_uri"), F.count_if(F.col("content").isNull()).alias("n_no_content"))


@query("SELECT DISTINCT d.dir FROM (" + r"SELECT regexp_replace(uri, '/[^/]*$', '') AS dir FROM documents WHERE uri IS NOT NULL" + r") d LEFT JOIN (SELECT DISTINCT regexp_replace(uri, '/[^/]*$', '') AS dir FROM memories WHERE layer = 'L0') m USING (dir) WHERE m.dir IS NULL")
def missing_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document directories without an abstract."""
    d = table(spark, sf_dir, "documents").where("uri IS NOT NULL").select(u.parent(F.col("uri")).alias("dir")).distinct()
    return d.join(table(spark, sf_dir, "memories").where("layer = 'L0' AND uri IS NOT NULL").select(u.parent(F.col("uri")).alias("dir")).distinct(), "dir", "left_anti")


# -- hybrid search -----------------------------------------------------------------------------------


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of text searches: every asked query whose number is divisible by 100."""
    return _asked(spark, sf_dir).where(F.conv(F.substring("query_id", 3, 8), 16, 10).cast("long") % 100 == 0)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every file: of several the greatest, so rows needn't be told apart first."""
    return table(spark, sf_dir, "memories").where("uri IS NOT NULL AND content IS NOT NULL").groupBy("uri").agg(F.max("content").alias("text"))


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _asked(spark, sf_dir).select("query_id", t.keywords(F.col("q")).alias("keywords"))
    return search.lexical(_files(spark, sf_dir), q, 10)


_SEARCHED = _ASKED + " AND ('0x' || substr(query_id, 3, 8))::BIGINT % 100 = 0"
_LEX = rf"""WITH q AS (SELECT query_id, unnest({_KEYS}) AS word FROM ({_ASKED})),
f AS (SELECT uri, max(content) AS text FROM memories WHERE uri IS NOT NULL AND content IS NOT NULL GROUP BY uri),
w AS (SELECT DISTINCT uri, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}+#]+')) AS word FROM f),
h AS (SELECT query_id, uri, count(*) AS hits FROM w JOIN q USING (word) GROUP BY ALL),
r AS (SELECT *, round(0.13 + least(hits, 6) * 0.05, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(0.13 + least(hits, 6) * 0.05, 6) DESC, uri) AS n FROM h)
"""


@query(_LEX + "SELECT query_id, uri, hits, score FROM r WHERE n <= 10")
def lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)


_LEX_SUB = _LEX.replace(_ASKED, _SEARCHED).replace("FROM w JOIN q USING (word) GROUP BY", "FROM f JOIN q ON contains(lower(f.text), word) GROUP BY")


@query(_LEX_SUB + "SELECT query_id, uri, hits, score FROM r WHERE n <= 10")
def lexical_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As lexical_scan, but keywords count wherever they stand in a text."""
    q = _searched(spark, sf_dir).select("query_id", t.keywords(F.col("q")).alias("keywords"))
    return search.lexical_substrings(_files(spark, sf_dir), q, 10)


_HITS = """WITH m AS (SELECT DISTINCT id, uri, content, importance_score::DOUBLE AS s FROM memories WHERE uri IS NOT NULL AND importance_score IS NOT NULL)
"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories as results of one search: uri, score, snippet."""
    return _memories(spark, sf_dir, "uri", "content", "importance_score").where("uri IS NOT NULL AND importance_score IS NOT NULL").select("uri", F.col("importance_score").cast("double").alias("score"), F.left("content", F.lit(40)).alias("snippet"))


@query(
    _HITS
    + r""", c AS (SELECT regexp_replace(uri, '/\.(abstract|overview)\.md$', '') AS canonical, uri, s, left(content, 40) AS snippet FROM m),
r AS (SELECT *, row_number() OVER w AS n, first_value(snippet IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY s DESC, uri ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM c WINDOW w AS (PARTITION BY canonical ORDER BY s DESC, uri))
SELECT canonical AS uri, round(s, 6) AS score FROM r WHERE n = 1"""
)
def dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dedup_canonical(_hits(spark, sf_dir), []).select("uri", F.round("score", 6).alias("score"))


@query(
    _HITS
    + """, l AS (SELECT uri, s AS score, 'layered' AS source FROM m WHERE s >= 0.5 UNION ALL SELECT uri, 1 - s, 'semantic' FROM m WHERE s < 0.7)
SELECT uri, round(max(score), 6) AS score, CASE WHEN min(source) = max(source) THEN min(source) ELSE 'hybrid' END AS source FROM l GROUP BY uri"""
)
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir)
    a = h.where("score >= 0.5").select("uri", "score", "snippet", F.lit("layered").alias("source"), F.lit(0).alias("ordinal"))
    b = h.where("score < 0.7").select("uri", (1 - F.col("score")).alias("score"), "snippet", F.lit("semantic").alias("source"), F.lit(1).alias("ordinal"))
    return search.merge_sources(a.unionByName(b), []).select("uri", F.round("score", 6).alias("score"), "source")


@query(
    _HITS
    + rf""", o AS (SELECT uri, {_SEG.format('uri')} AS s FROM (SELECT DISTINCT uri FROM m))
SELECT uri FROM o WHERE NOT (len(s) >= 3 AND EXISTS (SELECT 1 FROM memory_index i WHERE i.archived AND i.owner_id = o.s[2] AND i.id = regexp_replace(o.s[-1], '\.md$', '')))"""
)
def archived_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.without_archived(_hits(spark, sf_dir).select("uri").distinct(), table(spark, sf_dir, "memory_index"))


@query(
    _LEX
    + rf""", k AS (SELECT query_id, {_KEYS} AS keys, {_ENTS} AS ents FROM ({_ASKED})),
b AS (SELECT r.query_id, r.uri, r.score, lower(left(f.text, 200)) AS s, keys, ents FROM r JOIN f USING (uri) JOIN k USING (query_id) WHERE n <= 10)
SELECT query_id, uri, round(score + round(CASE WHEN ends_with(uri, '.md') AND NOT regexp_matches(uri, '/\.(abstract|overview)\.md$') THEN 0.12 ELSE -0.12 END
  + least(len(list_filter(keys, lambda x: contains(s, x))), 4) * 0.03 + least(len(list_filter(ents, lambda x: contains(s, lower(x)))), 3) * 0.05
  + CASE WHEN regexp_matches(lower(uri), '/(entities|events|goals|relationships)$') THEN -0.14 WHEN contains(lower(uri), '/entities/') THEN -0.08 ELSE 0 END, 6), 6) AS score FROM b"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword candidates of every asked query, re-ranked by path, keywords and entities of their snippet."""
    lex = _lexical(spark, sf_dir)
    # The first 200 characters of the greatest text are the greatest first 200 characters, so whole texts aren't shuffled for them.
    heads = table(spark, sf_dir, "memories").where("uri IS NOT NULL AND content IS NOT NULL").groupBy("uri").agg(F.max(F.left("content", F.lit(200))).alias("head"))
    heads = heads.select("uri", F.lower("head").alias("low"), search.place_bonus(F.col("uri")).alias("place"))
    q = _asked(spark, sf_dir).select("query_id", t.keywords(F.col("q")).alias("keys"), F.transform(t.entities(F.col("q")), F.lower).alias("ents"))
    x = lex.join(q, "query_id").join(heads, "uri")
    bonus = F.round(F.col("place") + search.match_bonus(F.col("low"), F.col("keys"), F.col("ents")), 6)
    return x.select("query_id", "uri", F.round(F.col("score") + bonus, 6).alias("score"))


@query(
    _LEX_SUB
    + rf""", k AS (SELECT query_id, {_KEYS} AS keys, {_ENTS} AS ents FROM ({_SEARCHED})),
c AS (SELECT r.query_id, r.uri, r.score, f.text, keys, ents, greatest(coalesce(list_min(list_filter(list_transform(keys, lambda x: strpos(lower(f.text), x)), lambda x: x > 0)), 1) - 80, 1) AS start FROM r JOIN f USING (uri) JOIN k USING (query_id)),
b AS (SELECT *, lower(substr(text, start, 220)) AS s FROM c),
x AS (SELECT query_id, uri, round(score + round(CASE WHEN ends_with(uri, '.md') AND NOT regexp_matches(uri, '/\.(abstract|overview)\.md$') THEN 0.12 ELSE -0.12 END
  + least(len(list_filter(keys, lambda x: contains(s, x))), 4) * 0.03 + least(len(list_filter(ents, lambda x: contains(s, lower(x)))), 3) * 0.05
  + CASE WHEN regexp_matches(lower(uri), '/(entities|events|goals|relationships)$') THEN -0.14 WHEN contains(lower(uri), '/entities/') THEN -0.08 ELSE 0 END, 6), 6) AS score FROM b)
SELECT query_id, uri, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) AS n FROM x) WHERE n <= 10"""
)
def hybrid_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every keyword candidate of every asked query re-ranked on its match, then cut. The tables hold no vectors of questions, so the vector list is empty."""
    q = _searched(spark, sf_dir).select("query_id", t.keywords(F.col("q")).alias("keywords"), t.entities(F.col("q")).alias("entities"))
    lex = search.lexical_substrings(_files(spark, sf_dir), q, None).select("query_id", "uri", "score", "snippet")
    none = spark.createDataFrame([], "query_id string, uri string, score double, snippet string, source string, ordinal int")
    return search.hybrid(none, lex, q, 10).select("query_id", "uri", "score")


@query(
    _LEX + rf"""SELECT s[1] AS scope, s[2] AS owner_id, regexp_replace(s[-1], '\.md$', '') AS memory_id, count(*) AS n_accesses FROM (SELECT {_SEG.format('uri')} AS s FROM r WHERE n <= 10) WHERE len(s) >= 3 GROUP BY ALL"""
)
def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.access_events(_lexical(spark, sf_dir)).groupBy("scope", "owner_id", "memory_id").agg(F.count("*").alias("n_accesses"))


# -- streams in batch form ---------------------------------------------------------------------------

_KINDS = ("signup", "purchase", "error", "view", "click")


@query("SELECT " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in _KINDS) + ", count(*) AS total FROM events WHERE event_type IN (" + ", ".join(f"'{k}'" for k in _KINDS) + ")")
def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.event_stats(_events(spark, sf_dir), _KINDS)


_GAP = """WITH e AS (SELECT event_type AS key, ts::TIMESTAMPTZ AS ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL {gap} SECOND THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY key ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts) AS run FROM g)
"""


@query(_GAP.format(gap=300) + "SELECT key, min(ts) AS first_at, max(ts) + INTERVAL 300 SECOND AS due_at, count(*) AS n_events FROM r GROUP BY key, run")
def debounce_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.debounce(_events(spark, sf_dir), "300 seconds")


@query()
def debounce_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts that a cap cuts are folded in order, which SQL can't express; tested against brute force."""
    return windows.debounce_capped(_events(spark, sf_dir), 300, 1200)


@query(_GAP.format(gap=120) + "SELECT key, max(ts) + INTERVAL 120 SECOND AS idle_at, count(*) AS n_events FROM r GROUP BY key, run")
def inactivity_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.inactive(_events(spark, sf_dir), "120 seconds")


@query("SELECT user_id AS key, ts::TIMESTAMPTZ AS fired_at, n // 10 AS fire_no FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 10 = 0")
def count_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.count_triggers(_events(spark, sf_dir).withColumn("key", F.col("user_id")), 10)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMPTZ) AS window_start, count(DISTINCT event_type) AS n_keys, count(*) AS n_events FROM events GROUP BY 1")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.micro_batches(_events(spark, sf_dir), "1 hour")


# -- evaluation --------------------------------------------------------------------------------------

_RECORDS = """WITH r AS (SELECT item_id, category, CASE item_id % 7 WHEN 0 THEN NULL WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS correct, length(question) / 100.0 AS seconds, length(evidence) AS tokens FROM eval_items WHERE category <> 5)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.when(F.col("item_id") % 7 == 0, None).when((F.col("item_id") % 7).isin(1, 2), False).otherwise(True)
    return table(spark, sf_dir, "eval_items").where("category <> 5").select("item_id", "category", grade.alias("correct"), (F.char_length("question") / 100.0).alias("seconds"), F.char_length("evidence").cast("long").alias("tokens"))


@query(_RECORDS + "SELECT category, count(*) AS total, count(*) FILTER (correct) AS correct, round(100.0 * count(*) FILTER (correct) / count(*), 2) AS score FROM r GROUP BY GROUPING SETS ((category), ())")
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.judge_summary(_records(spark, sf_dir))


@query(
    _RECORDS
    + """SELECT category, count(*) FILTER (correct) AS n_correct, count(*) FILTER (NOT correct) AS n_wrong, count(*) FILTER (correct IS NULL) AS n_none,
  round(count(*) FILTER (correct) / count(correct), 6) AS accuracy, round(count(*) FILTER (correct) / count(*), 6) AS share, round(avg(seconds), 6) AS mean_time, sum(tokens)::BIGINT AS tokens FROM r GROUP BY category"""
)
def answer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.answer_stats(_records(spark, sf_dir))


@query(
    """WITH i AS (SELECT owner_id, memory_type, count(*) AS n, count(*) FILTER (archived) AS n_archived, sum(access_count)::BIGINT AS n_accesses FROM memory_index GROUP BY ROLLUP (owner_id, memory_type))
SELECT owner_id, memory_type, n, n_archived, n_accesses FROM i"""
)
def index_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories, archived ones and accesses by owner and type, with totals."""
    i = table(spark, sf_dir, "memory_index").rollup("owner_id", "memory_type")
    return i.agg(F.count("*").alias("n"), F.count_if(F.coalesce("archived", F.lit(False))).alias("n_archived"), F.sum("access_count").alias("n_accesses"))


# -- layers, sync and sessions -----------------------------------------------------------------------

_DIR = r"""CASE WHEN regexp_matches(uri, '/\.(abstract|overview)\.md$') THEN regexp_replace(uri, '/\.(abstract|overview)\.md$', '') WHEN ends_with(uri, '.md') THEN regexp_replace(uri, '/[^/]*$', '') ELSE uri END"""


@query(
    f"""WITH m AS (SELECT DISTINCT id, uri, {_DIR} AS dir, coalesce(layer, 'L2') AS l, content FROM memories WHERE uri IS NOT NULL)
SELECT dir, sha256(min_by(content, uri) FILTER (l = 'L0' AND content IS NOT NULL)) AS abstract_hash, sha256(min_by(content, uri) FILTER (l = 'L1' AND content IS NOT NULL)) AS overview_hash, count(*) FILTER (l = 'L2') AS n_files FROM m GROUP BY dir"""
)
def layer_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layers.bundle(_memories(spark, sf_dir, "uri", "layer", "content"))
    return b.select("dir", F.sha2("abstract", 256).alias("abstract_hash"), F.sha2("overview", 256).alias("overview_hash"), "n_files")


@query(
    r"""WITH a AS (SELECT DISTINCT regexp_replace(uri, '/[^/]*$', '') AS dir, first_value(left(text, 120)) OVER (PARTITION BY regexp_replace(uri, '/[^/]*$', '') ORDER BY uri) AS abstract FROM documents WHERE text IS NOT NULL),
p AS (SELECT regexp_replace(dir, '/[^/]*$', '') AS parent, regexp_extract(dir, '([^/]*)$', 1) AS name, chr(10) || chr(10) || '## ' || regexp_extract(dir, '([^/]*)$', 1) || chr(10) || chr(10)
  || array_to_string(list_filter(string_split(abstract, chr(10)), lambda x: NOT (starts_with(x, '<!-- source-hash:') OR starts_with(x, '**Added**:'))), chr(10)) AS part FROM a)
SELECT parent AS dir, sha256(left(string_agg(part, '' ORDER BY name), 10000)) AS content_hash FROM p GROUP BY parent"""
)
def child_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory texts from children, each standing for its first document's beginning."""
    d = _documents(spark, sf_dir)
    a = d.groupBy(u.parent(F.col("uri")).alias("dir")).agg(F.min_by(F.left("text", F.lit(120)), "uri").alias("abstract"))
    return layers.child_abstracts(a).select("dir", F.sha2("content", 256).alias("content_hash"))


@query()
def layer_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts of every directory, level by level: a recursion over texts, tested against a fixture."""
    return layers.rebuilt(_documents(spark, sf_dir).select("uri", "text"))


@query(
    """WITH f AS (SELECT regexp_replace(uri, '/[^/]*$', '') AS dir, max(coalesce(updated_at, created_at)) AS newest FROM documents WHERE uri IS NOT NULL GROUP BY 1),
l AS (SELECT regexp_replace(uri, '/[^/]*$', '') AS dir, max(created_at) AS made FROM documents WHERE uri IS NOT NULL AND source = 'abstract' GROUP BY 1)
SELECT f.dir, newest FROM f LEFT JOIN l USING (dir) WHERE made IS NULL OR newest > made"""
)
def stale_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("uri IS NOT NULL")
    made = d.where("source = 'abstract'").select(u.parent(F.col("uri")).alias("dir"), F.col("created_at").alias("at"))
    return layers.stale(d.select("uri", F.coalesce("updated_at", "created_at").alias("at")), made)


_SYNC = r"""WITH f AS (SELECT file_path AS uri, max(content_hash) AS fh FROM memory_index WHERE file_path IS NOT NULL GROUP BY 1),
v AS (SELECT regexp_extract(uri, '^\w+://[^/]+/[^/]+/(.*)$', 1) AS uri, max(content_hash) AS vh FROM memories WHERE uri IS NOT NULL GROUP BY 1),
a AS (SELECT coalesce(f.uri, v.uri) AS uri, CASE WHEN v.uri IS NULL THEN 'add' WHEN f.uri IS NULL THEN 'delete' WHEN fh IS DISTINCT FROM vh THEN 'update' ELSE 'skip' END AS action FROM f FULL JOIN v ON f.uri = v.uri)
"""


def _sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "memory_index").select(F.col("file_path").alias("uri"), "content_hash")
    v = table(spark, sf_dir, "memories").where("uri IS NOT NULL").select(F.regexp_extract("uri", r"^\w+://[^/]+/[^/]+/(.*)$", 1).alias("uri"), "content_hash")
    return maintenance.sync_actions(files, v)


@query(_SYNC + "SELECT uri, action FROM a")
def sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir)


@query(_SYNC + "SELECT count(*) FILTER (action = 'skip') AS n_skipped, count(*) FILTER (action <> 'skip') AS n_done, round(count(*) FILTER (action = 'skip') / nullif(count(*), 0), 6) AS skip_rate FROM a")
def sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _sync(spark, sf_dir).agg(F.count_if(F.col("action") == "skip").alias("n_skipped"), F.count_if(F.col("action") != "skip").alias("n_done"))
    return n.withColumn("skip_rate", maintenance.rate(F.col("n_skipped"), F.col("n_done")))


_CURRENT = """WITH s AS (SELECT thread_id, max_by(struct_pack(status := status, participants := participants), (updated_at, message_count, status)) AS x FROM sessions GROUP BY thread_id)"""


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest_sessions(table(spark, sf_dir, "sessions").select("thread_id", "status", "participants", "updated_at", "message_count"))


@query(
    _CURRENT
    + rf""", v AS (SELECT DISTINCT {_TAIL} AS file_path FROM memories WHERE uri IS NOT NULL),
o AS (SELECT DISTINCT unnest(source_sessions) AS thread_id, id, file_path FROM memory_index),
n AS (SELECT thread_id, count(*) AS n_memories, count(v.file_path) AS n_vectors FROM o LEFT JOIN v USING (file_path) GROUP BY thread_id)
SELECT s.thread_id, x.status = 'closed' AS closed, coalesce(n_memories, 0) AS n_memories, coalesce(n_vectors, 0) AS n_vectors,
  coalesce(x.status = 'closed' AND n_memories > 0 AND n_memories = n_vectors, false) AS ready FROM s LEFT JOIN n USING (thread_id)"""
)
def session_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "memories").where("uri IS NOT NULL").select(F.regexp_extract("uri", r"^\w+://[^/]+/[^/]+/(.*)$", 1).alias("file_path"))
    return maintenance.ready_sessions(_current(spark, sf_dir).select("thread_id", "status"), table(spark, sf_dir, "memory_index"), v)


@query(
    _CURRENT
    + """, p AS (SELECT unnest(list_distinct(x.participants)) AS participant, x.status AS status FROM s)
SELECT participant, count(*) AS n_sessions, count(*) FILTER (status = 'active') AS n_open FROM p GROUP BY participant"""
)
def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.participants(_current(spark, sf_dir))


@query(_SENT + "SELECT thread_id, id, sent AS at FROM m WHERE sent BETWEEN TIMESTAMPTZ '2025-03-01 00:00:00+00' AND TIMESTAMPTZ '2025-05-31 23:59:59+00'")
def timeline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sent(spark, sf_dir).where("at BETWEEN TIMESTAMP '2025-03-01 00:00:00' AND TIMESTAMP '2025-05-31 23:59:59'").select("thread_id", "id", "at")


@query(
    _COS
    + """, t AS (SELECT query_id, vec_id, score, CASE WHEN score >= 0.45 THEN 0 WHEN score >= 0.3 THEN 1 ELSE 2 END AS tier, n FROM r WHERE n <= 30),
b AS (SELECT query_id, min(tier) AS best FROM t WHERE vec_id <> query_id GROUP BY query_id),
u AS (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY n) AS k FROM t JOIN b USING (query_id) WHERE tier <= best AND vec_id <> query_id)
SELECT query_id, vec_id, score, tier FROM u WHERE k <= 10"""
)
def layered_fallback_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without driver-side branching: rank all tiers of thresholds at once, keep each query's first that isn't empty."""
    e = table(spark, sf_dir, "embeddings")
    hits = search.top_k(_queries(e), e, 30)
    return search.first_tier(hits.where("query_id <> vec_id"), (0.45, 0.3), 10)


# -- listings, scans and text of the tree ------------------------------------------------------------


@query(
    r"""WITH l AS (SELECT regexp_replace(uri, '/[^/]*$', '') AS dir, max(content) AS abstract FROM memories WHERE layer = 'L0' AND uri IS NOT NULL AND content IS NOT NULL GROUP BY 1)
SELECT DISTINCT d.uri, regexp_replace(d.uri, '/[^/]*$', '') AS dir, sha256(coalesce(l.abstract, '')) AS abstract_hash FROM documents d LEFT JOIN l ON l.dir = regexp_replace(d.uri, '/[^/]*$', '')
WHERE d.text IS NOT NULL AND regexp_matches(d.uri, '^\w+://user/') AND NOT starts_with(regexp_extract(d.uri, '([^/]*)$', 1), '.')"""
)
def recursive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visible files of a dimension with the abstract of their directory."""
    m = table(spark, sf_dir, "memories").where("layer = 'L0' AND uri IS NOT NULL AND content IS NOT NULL")
    abstracts = m.groupBy(u.parent(F.col("uri")).alias("dir")).agg(F.max("content").alias("abstract"))
    own = _documents(spark, sf_dir).select("uri").where(F.col("uri").rlike(r"^\w+://user/"))
    return tree.recursive(own, abstracts).select("uri", "dir", F.sha2(F.coalesce("abstract", F.lit("")), 256).alias("abstract_hash")).distinct()


@query("SELECT DISTINCT id, uri FROM memories WHERE uri IS NOT NULL AND contains(uri, '/timeline/') AND ends_with(uri, '.md') AND NOT starts_with(regexp_extract(uri, '([^/]*)$', 1), '.')")
def message_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message files below a timeline, at any depth."""
    return sessions.message_files(_memories(spark, sf_dir, "uri"))


@query(r"SELECT DISTINCT id, lower(regexp_extract(content, '(?i)(?:^|\n)[^\n]*?ID:[ `*]*([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})', 1)) AS found FROM messages WHERE regexp_matches(content, '(?i)(?:^|\n)[^\n]*?ID:[ `*]*([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})')")
def loose_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written loosely in a text."""
    m = table(spark, sf_dir, "messages").select("id", sessions.loose_id(F.col("content")).alias("found"))
    return m.where("found IS NOT NULL").distinct()


@query("SELECT DISTINCT m.id FROM messages m WHERE m.thread_id IS NOT NULL AND m.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM memories v WHERE v.id = m.id)")
def unindexed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without a vector."""
    m = table(spark, sf_dir, "messages").where("thread_id IS NOT NULL AND id IS NOT NULL")
    return maintenance.unindexed(m, table(spark, sf_dir, "memories")).select("id").distinct()


@query("SELECT id, uri FROM (SELECT DISTINCT id, uri, layer FROM memories WHERE layer = 'L2') ORDER BY id LIMIT 100")
def filtered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred vectors of a layer, in order of id."""
    return _memories(spark, sf_dir, "uri", "layer").where(MemoryFilter(layer="L2").column()).orderBy("id").limit(100).select("id", "uri")


@query("SELECT q.id, v.id IS NOT NULL AS found, CASE WHEN v.id IS NOT NULL THEN 1.0::DOUBLE END AS score FROM (SELECT DISTINCT id FROM memory_index) q LEFT JOIN (SELECT DISTINCT id FROM memories) v USING (id)")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's ids looked up among the vectors."""
    return maintenance.looked_up(table(spark, sf_dir, "memory_index").select("id").distinct(), _memories(spark, sf_dir))


@query(
    r"""WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)(\n\n)?\*\*Added\*\*:.*$', ''), '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, strlen(t)::BIGINT AS n_bytes FROM x WHERE strlen(t) > 2000"""
)
def oversized_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are too long for an abstract, in bytes."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.octet_length(t.without_added(F.col("text"))).cast("long").alias("n_bytes")).where("n_bytes > 2000")


@query(
    _SENT
    + """, d AS (SELECT thread_id, strftime(sent, '%Y-%m') AS month, strftime(sent, '%d') AS day, count(*) AS n, string_agg('- ' || strftime(sent, '%H:%M:%S') || ' ' || left(id, 8), chr(10) ORDER BY sent, id) AS entries FROM m WHERE sent IS NOT NULL GROUP BY ALL)
SELECT thread_id, month, day, sha256('# ' || month || '-' || day || chr(10) || chr(10) || '**Messages**: ' || n || chr(10) || chr(10) || entries || chr(10)) AS index_hash FROM d"""
)
def daily_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered index of every day of every thread."""
    d = sessions.daily_index(_sent(spark, sf_dir).select("thread_id", "id", "at"))
    return d.select("thread_id", "month", "day", F.sha2("markdown", 256).alias("index_hash"))


@query(
    _SENT
    + """, d AS (SELECT thread_id, strftime(sent, '%Y-%m') AS month, strftime(sent, '%d') AS day, count(*) AS n FROM m WHERE sent IS NOT NULL GROUP BY ALL)
SELECT thread_id, month, sha256('# ' || month || chr(10) || chr(10) || '**Messages**: ' || sum(n) || chr(10) || chr(10) || string_agg('- ' || day || ': ' || n, chr(10) ORDER BY day) || chr(10)) AS index_hash FROM d GROUP BY thread_id, month
UNION ALL SELECT thread_id, left(month, 4), sha256('# ' || left(month, 4) || chr(10) || chr(10) || string_agg('- ' || month, chr(10) ORDER BY month) || chr(10)) FROM (SELECT DISTINCT thread_id, month FROM d) GROUP BY thread_id, left(month, 4)"""
)
def monthly_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered indexes of every month and year of every thread; a year's month is the year alone."""
    return sessions.period_indexes(_sent(spark, sf_dir).select("thread_id", "id", "at")).select("thread_id", "month", F.sha2("markdown", 256).alias("index_hash"))


@query(
    _SENT
    + """, r AS (SELECT thread_id, content, sent, id, row_number() OVER (PARTITION BY thread_id ORDER BY sent, id) AS n, count(*) OVER (PARTITION BY thread_id) AS total FROM m WHERE sent IS NOT NULL AND content IS NOT NULL),
p AS (SELECT thread_id, n, total, chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Message: ' || left(id, 8) || chr(10) || chr(10) || content AS part FROM r),
b AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY thread_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
c AS (SELECT thread_id, '# Timeline Messages: ' || any_value(total) || string_agg(part, '' ORDER BY n) AS c FROM b WHERE before <= 15000 GROUP BY thread_id)
SELECT thread_id, sha256(CASE WHEN length(c) > 15000 THEN left(c, 15000) || chr(10) || chr(10) || '[...]' ELSE c END) AS content_hash FROM c"""
)
def timeline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every thread that its layers are made from."""
    return sessions.timeline_text(_sent(spark, sf_dir).where("content IS NOT NULL")).select("thread_id", F.sha2("content", 256).alias("content_hash"))


@query(
    r"""WITH d AS (SELECT DISTINCT regexp_replace(uri, '/[^/]*$', '') AS dir FROM documents WHERE uri IS NOT NULL),
l AS (SELECT regexp_replace(uri, '/[^/]*$', '') AS dir, bool_or(layer = 'L0') AND bool_or(layer = 'L1') AS ok FROM memories WHERE uri IS NOT NULL AND layer IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_dirs, count(*) FILTER (coalesce(ok, false)) AS n_complete, count(*) FILTER (NOT coalesce(ok, false)) AS n_missing,
  CASE WHEN count(*) = 0 THEN 100 ELSE count(*) FILTER (coalesce(ok, false)) * 100 // count(*) END AS percent FROM d LEFT JOIN l USING (dir)"""
)
def layer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many document directories have both layers."""
    d = table(spark, sf_dir, "documents").where("uri IS NOT NULL").select(u.parent(F.col("uri")).alias("dir")).distinct()
    m = table(spark, sf_dir, "memories").where("uri IS NOT NULL AND layer IS NOT NULL").select(u.parent(F.col("uri")).alias("dir"), "layer")
    return tree.coverage_totals(d, m)


@query(
    rf"""WITH s AS (SELECT {_SEG.format('uri')} AS s, uri FROM documents WHERE text IS NOT NULL AND uri IS NOT NULL)
SELECT s[1] AS dimension, count(DISTINCT regexp_replace(uri, '/[^/]*$', '')) AS n_dirs, count(*) AS n_files, count(*) FILTER (contains(uri, '/timeline/')) AS n_messages,
  count(*) FILTER (regexp_matches(uri, '/timeline/[^/]*$')) AS n_direct FROM s GROUP BY 1"""
)
def dimension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories, files and messages of every dimension; messages at any depth and directly below a timeline."""
    return tree.dimensions(_documents(spark, sf_dir).where("uri IS NOT NULL").select("uri"))


# -- intents and semantic search ---------------------------------------------------------------------


@query("SELECT * FROM (VALUES " + ", ".join(f"('{i}', {a / (a + b + c)!r}::DOUBLE, {b / (a + b + c)!r}::DOUBLE, {c / (a + b + c)!r}::DOUBLE, {t0!r}::DOUBLE)" for i, a, b, c, t0 in search.INTENT_RULES) + ") r(intent, w0, w1, w2, threshold)")
def intent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and threshold of every intent, the weights summing to one."""
    return search.normalised(search.intent_rules(table(spark, sf_dir, "region")))


_PLACED = "CASE coalesce(layer, 'L2') WHEN 'L2' THEN 0.08 WHEN 'L1' THEN -0.04 WHEN 'L0' THEN -0.08 ELSE 0 END"


@query(
    rf"""WITH v AS (SELECT id, max_by(struct_pack(e := embedding::DOUBLE[], uri := uri, layer := layer, c := content), ingested_at) AS x FROM memories WHERE embedding IS NOT NULL AND len(embedding) = 64 GROUP BY id),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, id, round(list_cosine_similarity(q.e, x.e), 6) AS score FROM q, v WHERE list_sum(list_transform(x.e, lambda y: abs(y))) > 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s) WHERE n <= 30 AND score >= 0.2),
c AS (SELECT query_id, coalesce(x.uri, k.id) AS uri, regexp_replace(coalesce(x.uri, k.id), '/\.(abstract|overview)\.md$', '') AS canonical, score, x.layer AS layer FROM k JOIN v USING (id)),
b AS (SELECT query_id, uri, canonical, round(score + {_PLACED} + round(CASE WHEN ends_with(canonical, '.md') THEN 0.12 ELSE -0.12 END
  + CASE WHEN regexp_matches(lower(canonical), '/(entities|events|goals|relationships)$') THEN -0.14 WHEN contains(lower(canonical), '/entities/') THEN -0.08 ELSE 0 END, 6), 6) AS score FROM c),
d AS (SELECT query_id, canonical AS uri, max(score) AS score FROM b GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) AS n FROM d) WHERE n <= 10),
o AS (SELECT *, {_SEG.format('uri')} AS s FROM t)
SELECT query_id, uri, score FROM o WHERE NOT (coalesce(len(s), 0) >= 3 AND EXISTS (SELECT 1 FROM memory_index i WHERE i.archived AND i.owner_id = o.s[2] AND i.id = regexp_replace(o.s[-1], '\.md$', '')))"""
)
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search over all layers, re-ranked, one result for each canonical URI, archived memories dropped after the cut."""
    m = table(spark, sf_dir, "memories").where("embedding IS NOT NULL AND size(embedding) = 64").select("id", "embedding", "uri", "layer", "content", "ingested_at")
    v = merge.latest(m, ["id"], [F.col("ingested_at")]).withColumnRenamed("id", "vec_id")
    q = _queries(table(spark, sf_dir, "embeddings"))
    return search.semantic(q, v, table(spark, sf_dir, "memory_index"), threshold=0.2, limit=10)
