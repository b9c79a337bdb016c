"""The registered queries of the core engine and, for each, equivalent SQL.

Facts are derived from ``events``: a subject per user, the event type as object, the event's time as valid
time, and a delayed transaction time, so that some facts arrive late. Signups and purchases are unique
facts. Graph queries use customers, nations and regions; names are those of parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text, vectors
from factloom.functions.temporal import AsOf, as_of
from factloom.operators import dictionary, facts, fulltext, graph, provenance, resolution, retrieval, vector
from factloom.plans import compile as plans
from factloom.plans.parser import parse
from factloom.errors import QueryError
from factloom.sources import version_log

ORDER = ("tx_time", "edge_id")
#: A point within the events' month, as valid time and as transaction time.
AT = 1705320000000
LATE = 1706400000000
QUESTION = f'MATCH (n) WHERE SIMILAR(n, "user 8 purchase") AS OF VALID TIME {AT} TRAVERSE SEMANTIC(budget = 40 tokens) RETURN CONTEXT(cite = true)'
SPARK, SQL = {}, {}


def query(sql: str | None):
    """Register a function under its name, with its SQL."""

    def add(function):
        SPARK[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ops(spark: SparkSession, sf_dir: str, policy: str | None = None) -> DataFrame:
    """The operation log of the events: upserts in order of (tx_time, edge_id)."""
    millis = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
    chosen = f"'{policy}'" if policy else "case when event_type in ('signup', 'purchase') then 'unique' else 'append' end"
    return _table(spark, sf_dir, "events").selectExpr(
        "'upsert' as op",
        "event_id + 1 as edge_id",
        "user_id % 3 as tenant",
        "concat('user:', user_id) as subject",
        "'did' as predicate",
        "event_type as object",
        f"{millis} as valid_from",
        f"{millis} + (event_id % 5) * 3600000 as tx_time",
        "event_id div 10 as doc",
        "event_id % 10 as chunk",
        f"{chosen} as policy",
        "cast(null as long) as retract_target",
    )


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.spans(event_ops(spark, sf_dir), ORDER)


OPS_SQL = """ops AS (
  SELECT event_id + 1 AS edge_id, user_id % 3 AS tenant, 'user:' || user_id AS subject, 'did' AS predicate, event_type AS object,
    epoch_us(ts) // 1000 AS valid_from, epoch_us(ts) // 1000 + (event_id % 5) * 3600000 AS tx, event_id // 10 AS doc, event_id % 10 AS chunk,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'unique' ELSE 'append' END AS policy
  FROM events)"""
FACTS_SQL = f"""{OPS_SQL},
marked AS (
  SELECT *, first_value(CASE WHEN policy = 'unique' THEN {{'tx': tx, 'id': edge_id, 'vf': valid_from}} END IGNORE NULLS) OVER (
    PARTITION BY tenant, subject, predicate ORDER BY tx, edge_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closer
  FROM ops),
facts AS (
  SELECT *, closer.vf AS valid_to, tx AS tx_from, CAST(NULL AS BIGINT) AS tx_to, closer.id AS invalidated_by,
    subject || ' ' || predicate || ' ' || object AS sentence
  FROM marked)"""
SEEN = "edge_id, tenant, subject, predicate, object, valid_from"
MAX = "9223372036854775807"


def _visible(valid: str, tx: str) -> str:
    return f"valid_from <= {valid} AND (valid_to IS NULL OR {valid} < valid_to) AND tx_from <= {tx} AND (tx_to IS NULL OR {tx} < tx_to)"


def _seen(df: DataFrame) -> DataFrame:
    return df.select(*SEEN.split(", "))


# -- points in time


@query(f"WITH {FACTS_SQL} SELECT {SEEN} FROM facts WHERE {_visible(MAX, MAX)}")
def as_of_now(spark, sf_dir):
    return _seen(as_of(event_facts(spark, sf_dir), AsOf.now()))


@query(f"WITH {FACTS_SQL} SELECT {SEEN} FROM facts WHERE {_visible(str(AT), MAX)}")
def as_of_valid(spark, sf_dir):
    return _seen(as_of(event_facts(spark, sf_dir), AsOf.valid(AT)))


@query(f"WITH {FACTS_SQL} SELECT {SEEN} FROM facts WHERE {_visible(MAX, str(LATE))}")
def as_of_tx(spark, sf_dir):
    return _seen(as_of(event_facts(spark, sf_dir), AsOf.transaction(LATE)))


@query(f"WITH {FACTS_SQL} SELECT {SEEN} FROM facts WHERE {_visible(str(AT), str(AT + 86400000))}")
def as_of_both(spark, sf_dir):
    return _seen(as_of(event_facts(spark, sf_dir), AsOf(AT, AT + 86_400_000)))


@query(f"WITH {FACTS_SQL} SELECT {SEEN} FROM facts WHERE {_visible(MAX, MAX)} AND tenant = 1")
def tenant_scope(spark, sf_dir):
    return _seen(as_of(event_facts(spark, sf_dir), AsOf.now(), tenant=1))


# -- upserts and retractions


@query(f"WITH {FACTS_SQL} SELECT edge_id, valid_from, valid_to, tx_from, tx_to FROM facts")
def upsert_spans(spark, sf_dir):
    return event_facts(spark, sf_dir).select("edge_id", "valid_from", "valid_to", "tx_from", "tx_to")


@query(f"WITH {FACTS_SQL} SELECT edge_id, invalidated_by, valid_to FROM facts WHERE invalidated_by IS NOT NULL")
def upsert_invalidated(spark, sf_dir):
    return event_facts(spark, sf_dir).filter("invalidated_by is not null").select("edge_id", "invalidated_by", "valid_to")


_ALL_OPEN = f"WITH {OPS_SQL} SELECT tenant, count(*) AS n_facts, count(*) AS n_open FROM ops GROUP BY tenant"


def _open_counts(spark, sf_dir, policy):
    found = facts.spans(event_ops(spark, sf_dir, policy), ORDER)
    return found.groupBy("tenant").agg(F.count(F.lit(1)).alias("n_facts"), F.sum(F.col("valid_to").isNull().cast("long")).alias("n_open"))


@query(_ALL_OPEN)
def append_only(spark, sf_dir):
    return _open_counts(spark, sf_dir, "append")


@query(_ALL_OPEN)
def semantic_policy(spark, sf_dir):
    return _open_counts(spark, sf_dir, "semantic")


@query(f"WITH {FACTS_SQL} SELECT edge_id, valid_from, valid_to FROM facts WHERE valid_to <= valid_from")
def late_arrivals_inverted(spark, sf_dir):
    return event_facts(spark, sf_dir).filter("valid_to <= valid_from").select("edge_id", "valid_from", "valid_to")


def _retracts(spark, sf_dir):
    """Every seventh fact is retracted two hours after it was told, and every fourteenth again later."""
    base = event_ops(spark, sf_dir).filter("edge_id % 7 = 0")
    first = base.withColumns({"op": F.lit("retract"), "retract_target": F.col("edge_id"), "tx_time": F.col("tx_time") + 7_200_000})
    return first.union(first.filter("edge_id % 14 = 0").withColumn("tx_time", F.col("tx_time") + 86_400_000))


@query(
    f"""WITH {FACTS_SQL}
SELECT edge_id, valid_from,
  CASE WHEN closer IS NOT NULL AND (edge_id % 7 <> 0 OR tx + 7200000 > closer.tx OR (tx + 7200000 = closer.tx AND edge_id > closer.id)) THEN closer.vf END AS valid_to,
  tx_from, CASE WHEN edge_id % 14 = 0 THEN tx + 93600000 WHEN edge_id % 7 = 0 THEN tx + 7200000 END AS tx_to
FROM facts"""
)
def retract_tx(spark, sf_dir):
    ops = event_ops(spark, sf_dir).union(_retracts(spark, sf_dir))
    return facts.spans(ops, ORDER).select("edge_id", "valid_from", "valid_to", "tx_from", "tx_to")


@query(
    f"""WITH {FACTS_SQL}, u AS (SELECT * FROM facts WHERE policy = 'unique')
SELECT a.edge_id AS a, b.edge_id AS b FROM u a JOIN u b
ON a.tenant = b.tenant AND a.subject = b.subject AND a.predicate = b.predicate AND a.edge_id < b.edge_id
  AND a.valid_from < coalesce(b.valid_to, {MAX}) AND b.valid_from < coalesce(a.valid_to, {MAX})"""
)
def valid_overlap_pairs(spark, sf_dir):
    return facts.overlapping_pairs(event_facts(spark, sf_dir).filter("policy = 'unique'"))


@query(f"WITH {OPS_SQL}, known AS (SELECT * FROM ops WHERE tx <= {AT}) SELECT tenant, count(*) AS n_facts FROM known GROUP BY tenant")
def believed_counts(spark, sf_dir):
    return facts.believed_at(event_ops(spark, sf_dir), AT, ORDER).groupBy("tenant").agg(F.count(F.lit(1)).alias("n_facts"))


# -- dictionary, provenance, access


@query(f"WITH {OPS_SQL} SELECT edge_id, row_number() OVER (ORDER BY tx, edge_id) AS number FROM ops")
def edge_numbers(spark, sf_dir):
    return dictionary.number_rows(event_ops(spark, sf_dir).select("edge_id", "tx_time"), *ORDER, name="number").select("edge_id", "number")


def _sequenced(spark, sf_dir):
    return dictionary.number_rows(event_ops(spark, sf_dir), *ORDER, name="ingest_seq")


_SEQ_SQL = f"{OPS_SQL}, seq AS (SELECT *, row_number() OVER (ORDER BY tx, edge_id) AS n FROM ops)"
_NODES_SQL = f"""{_SEQ_SQL}, names AS (SELECT name, min(pos) AS pos FROM (SELECT subject AS name, 2 * n AS pos FROM seq UNION ALL SELECT object, 2 * n + 1 FROM seq) GROUP BY name),
nodes AS (SELECT row_number() OVER (ORDER BY pos) AS node_id, name FROM names)"""


@query(f"WITH {_NODES_SQL} SELECT node_id, name FROM nodes")
def intern_nodes(spark, sf_dir):
    return dictionary.intern_nodes(_sequenced(spark, sf_dir))


@query("SELECT 1 AS predicate_id, 'did' AS name")
def intern_predicates(spark, sf_dir):
    return dictionary.intern_predicates(_sequenced(spark, sf_dir)).withColumn("predicate_id", F.col("predicate_id").cast("int"))


@query(
    f"""WITH {_NODES_SQL} SELECT s.edge_id, coalesce(a.name, 'node#' || x.node_id) || ' did ' || s.object AS sentence
FROM seq s JOIN nodes x ON s.subject = x.name LEFT JOIN (SELECT * FROM nodes WHERE node_id % 5 <> 0) a ON x.node_id = a.node_id
WHERE s.object IN (SELECT name FROM nodes WHERE node_id % 5 <> 0)"""
)
def verbalize(spark, sf_dir):
    """Sentences where every fifth name is unknown; facts whose object is unknown are left out."""
    ops = _sequenced(spark, sf_dir)
    nodes, predicates = dictionary.intern_nodes(ops), dictionary.intern_predicates(ops)
    known = nodes.filter("node_id % 5 <> 0")
    coded = dictionary.encode_facts(ops.select("edge_id", "subject", "predicate", "object"), nodes, predicates)
    coded = coded.join(known.select(F.col("node_id").alias("object_id")), "object_id", "left_semi")
    return dictionary.decode_facts(coded, known, predicates).select("edge_id", "sentence")


@query(f"WITH {FACTS_SQL} SELECT edge_id, doc, chunk FROM facts WHERE doc = 5")
def prov_by_doc(spark, sf_dir):
    return provenance.facts_from_doc(event_facts(spark, sf_dir), 5).select("edge_id", "doc", "chunk")


@query(f"WITH {FACTS_SQL} SELECT edge_id, doc, chunk FROM facts WHERE doc = 5 AND chunk = 3")
def prov_by_chunk(spark, sf_dir):
    return provenance.facts_from_chunk(event_facts(spark, sf_dir), 5, 3).select("edge_id", "doc", "chunk")


@query(f"WITH {FACTS_SQL} SELECT 'retract' AS op, edge_id AS retract_target, CAST({AT} AS BIGINT) AS tx_time, tenant FROM facts WHERE doc = 5 AND tx_to IS NULL")
def prov_cascade(spark, sf_dir):
    return provenance.cascade_on_retract(event_facts(spark, sf_dir), 5, AT)


@query(f"WITH {FACTS_SQL} SELECT edge_id, subject, object FROM facts WHERE CAST(substr(subject, 6) AS BIGINT) % 2 = 0 AND object IN ('purchase', 'view')")
def acl_semi_join(spark, sf_dir):
    """The principal may read even users, purchases and views."""
    known = event_facts(spark, sf_dir)
    users = known.select(F.col("subject").alias("node")).filter("try_cast(substr(node, 6) as long) % 2 = 0")
    things = known.select(F.col("object").alias("node")).filter("node in ('purchase', 'view')")
    acl = users.union(things).distinct().withColumn("principal", F.lit("p1"))
    return provenance.readable(known, acl, "p1").select("edge_id", "subject", "object")


@query("SELECT conv_id AS doc, turn AS chunk, text, conv_id * 1000 + turn AS reference_time FROM conversations")
def episodes(spark, sf_dir):
    return provenance.episodes(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", F.expr("conv_id * 1000 + turn"))


# -- versions

_LOG_SQL = "log AS (SELECT 'k' || (o_orderkey % 500) AS key, o_orderkey AS seq, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS value FROM orders)"
_NEWEST_SQL = f"{_LOG_SQL}, newest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM log WHERE seq <= 5000)"


def _log(spark, sf_dir):
    return _table(spark, sf_dir, "orders").selectExpr("cast(concat('k', o_orderkey % 500) as binary) as key", "o_orderkey as commit_seq", "case when o_orderkey % 10 <> 0 then cast(o_orderstatus as binary) end as value")


@query(f"WITH {_NEWEST_SQL} SELECT key, value FROM newest WHERE n = 1 AND value IS NOT NULL")
def mvcc_snapshot_get(spark, sf_dir):
    return version_log.snapshot(_log(spark, sf_dir), 5000).selectExpr("cast(key as string) as key", "cast(value as string) as value")


@query(f"WITH {_NEWEST_SQL} SELECT key, value FROM newest WHERE n = 1 AND value IS NOT NULL AND starts_with(key, 'k12')")
def mvcc_prefix_scan(spark, sf_dir):
    return version_log.scan_prefix(_log(spark, sf_dir), 5000, b"k12").selectExpr("cast(key as string) as key", "cast(value as string) as value")


# -- full text


def _tokens_sql(column: str) -> str:
    return rf"list_filter(string_split_regex(lower({column}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: t <> '')"


def _bm25_sql(corpus: str, words: str) -> str:
    """CTEs ending in ``scored(key, score)``; ``corpus`` selects key and text."""
    terms = fulltext.query_terms(words)
    distinct = list(dict.fromkeys(terms))
    tf = ", ".join(f"len(list_filter(w, lambda t: t = '{t}')) AS tf{i}" for i, t in enumerate(distinct))
    df = ", ".join(f"sum((tf{i} > 0)::BIGINT) AS df{i}" for i in range(len(distinct)))
    part = " + ".join(f"{terms.count(t)} * ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * (tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * dl / avgdl)))" for i, t in enumerate(distinct))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(distinct)))
    return f"""words AS (SELECT key, {_tokens_sql("text")} AS w FROM ({corpus})),
counted AS (SELECT key, len(w) AS dl, {tf} FROM words), stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM counted),
scored AS (SELECT key, {part} AS score FROM counted, stats WHERE {some})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"WITH t AS (SELECT doc_id, unnest({_tokens_sql('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term")
def tokenize_df(spark, sf_dir):
    index = fulltext.postings(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query(f"WITH w AS (SELECT len({_tokens_sql('text')}) AS dl FROM documents) SELECT count(*) AS n, sum(dl)::BIGINT AS total_len, round(avg(dl), 6) AS avgdl FROM w")
def fulltext_stats(spark, sf_dir):
    return fulltext.corpus_stats(_table(spark, sf_dir, "documents")).withColumn("avgdl", F.round("avgdl", 6))


_DOCS = "SELECT doc_id AS key, text FROM documents"


@query(f"WITH {_bm25_sql(_DOCS, 'the reason of thinking')} SELECT key, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, key LIMIT 20")
def bm25_documents(spark, sf_dir):
    return _rounded(fulltext.search(_table(spark, sf_dir, "documents"), "the reason of thinking", 20, "doc_id"))


@query(f"WITH {_bm25_sql(_DOCS, 'of the the')} SELECT key, round(score, 6) AS score FROM scored")
def bm25_dup_terms(spark, sf_dir):
    return _rounded(fulltext.bm25(_table(spark, sf_dir, "documents"), "of the the", "doc_id"))


@query(f"WITH {_bm25_sql(_DOCS, 'one the')} SELECT key, round(score, 6) AS score FROM scored")
def bm25_inverted(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return _rounded(fulltext.bm25_postings(fulltext.postings(docs, "doc_id"), fulltext.corpus_stats(docs), "one the"))


@query(f"WITH {_bm25_sql('SELECT doc_id AS key, text FROM documents WHERE doc_id % 10 <> 3', 'the')} SELECT key, round(score, 6) AS score FROM scored")
def bm25_after_removal(spark, sf_dir):
    """Scores after the removal of every tenth document from the corpus."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = docs.filter("doc_id % 10 = 3").select("doc_id", F.lit(None).cast("string").alias("text"))
    return _rounded(fulltext.bm25(fulltext.reindex(docs, gone, "doc_id"), "the", "doc_id"))


_FACT_SCORES = _bm25_sql("SELECT edge_id AS key, sentence AS text FROM facts", "user 8 purchase")


@query(f"WITH {FACTS_SQL}, {_FACT_SCORES} SELECT key, round(score, 6) AS score FROM scored")
def bm25_facts(spark, sf_dir):
    return _rounded(fulltext.bm25(retrieval.sentences(event_facts(spark, sf_dir)), "user 8 purchase", "edge_id", "sentence"))


# -- retrieval

_RANKED_SQL = f"""{FACTS_SQL}, {_FACT_SCORES},
ranked AS (SELECT f.*, s.score, greatest(1, len(string_split_regex(trim(sentence), '\\s+'))) AS cost FROM facts f JOIN scored s ON s.key = f.edge_id WHERE {_visible(str(AT), MAX)}),
placed AS (SELECT *, row_number() OVER o AS rank, sum(cost) OVER (o ROWS UNBOUNDED PRECEDING) AS used FROM ranked WINDOW o AS (ORDER BY score DESC, edge_id DESC)),
cut AS (SELECT * FROM placed WHERE used <= 40)"""


def _cut(spark, sf_dir):
    return plans.chosen(parse(QUESTION), event_facts(spark, sf_dir))


@query(f"WITH {_RANKED_SQL} SELECT edge_id, round(score, 6) AS score FROM ranked")
def similar_as_of(spark, sf_dir):
    return _rounded(plans.ranked(parse(QUESTION), event_facts(spark, sf_dir)).select("edge_id", "score"))


@query(f"WITH {_RANKED_SQL} SELECT rank::BIGINT AS rank, edge_id, cost::BIGINT AS cost, used::BIGINT AS used, round(score, 6) AS score FROM cut")
def budget_prefix(spark, sf_dir):
    return _rounded(_cut(spark, sf_dir).select(F.col("rank").cast("long").alias("rank"), "edge_id", "cost", "used", "score"))


@query(f"WITH {_RANKED_SQL} SELECT string_agg('- ' || sentence, chr(10) ORDER BY rank) AS text FROM cut")
def context_text(spark, sf_dir):
    return plans.answer(QUESTION, event_facts(spark, sf_dir)).select("text")


@query(f"WITH {_RANKED_SQL} SELECT (rank - 1)::BIGINT AS position, doc, chunk, sentence AS snippet FROM cut")
def context_citations(spark, sf_dir):
    cited = plans.answer(QUESTION, event_facts(spark, sf_dir)).select(F.posexplode("citations").alias("position", "c"))
    return cited.select(F.col("position").cast("long").alias("position"), "c.doc", "c.chunk", "c.snippet")


@query(
    f"""WITH {_RANKED_SQL}, ends AS (SELECT subject AS name, 2 * rank AS pos FROM cut UNION ALL SELECT object, 2 * rank + 1 FROM cut)
SELECT name, row_number() OVER (ORDER BY min(pos)) AS position FROM ends GROUP BY name"""
)
def retrieve_nodes(spark, sf_dir):
    return retrieval.subgraph_nodes(_cut(spark, sf_dir))


@query(f"WITH {_RANKED_SQL} SELECT edge_id, subject, predicate, object FROM cut")
def retrieve_edges(spark, sf_dir):
    return _cut(spark, sf_dir).select("edge_id", "subject", "predicate", "object")


def _named_edges(spark, sf_dir):
    people = _table(spark, sf_dir, "customer")
    edges = people.selectExpr("c_custkey as pos", "c_custkey + 1000 as subject_id", "cast(1 as long) as predicate_id", "cast(c_nationkey as long) as object_id")
    nodes = people.filter("c_custkey % 4 <> 0").selectExpr("c_custkey + 1000 as node_id", "c_name as name")
    return edges, nodes.union(_table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as long)", "n_name"))


_EDGES_SQL = """edges AS (SELECT c_custkey AS pos, c_custkey + 1000 AS subject_id, c_nationkey::BIGINT AS object_id, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS s, n_name AS o
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey),
fits AS (SELECT * FROM (SELECT *, sum(coalesce(len(string_split(s, ' ')), 1) + coalesce(len(string_split(o, ' ')), 1) + 1) OVER (ORDER BY pos) AS used FROM edges) WHERE used <= 50)"""


@query(f"WITH {_EDGES_SQL} SELECT pos, subject_id, object_id FROM fits")
def greedy_budget(spark, sf_dir):
    edges, nodes = _named_edges(spark, sf_dir)
    return retrieval.greedy_budget(edges, nodes, 50)[0].select("pos", "subject_id", "object_id")


@query(f"WITH {_EDGES_SQL}, used_ids AS (SELECT subject_id AS node_id FROM fits UNION SELECT object_id FROM fits) SELECT node_id FROM used_ids WHERE node_id < 1000 OR (node_id - 1000) % 4 <> 0")
def greedy_budget_nodes(spark, sf_dir):
    edges, nodes = _named_edges(spark, sf_dir)
    return retrieval.greedy_budget(edges, nodes, 50)[1].select("node_id")


@query(f"WITH {_EDGES_SQL} SELECT string_agg('- ' || coalesce(s, '?') || ' rel#1 ' || coalesce(o, '?'), chr(10) ORDER BY pos) AS text FROM fits")
def context_serializer(spark, sf_dir):
    edges, nodes = _named_edges(spark, sf_dir)
    kept, used = retrieval.greedy_budget(edges, nodes, 50)
    return retrieval.serialize_edges(kept, used)


_QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _first_vector(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


@query(
    f"""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}) + 0.5 * (vec_id % 7) / 7 + 0.8 * label / 10 + 0.3 * (vec_id % 11) / 11 + CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0.0 END, 6) AS score
FROM embeddings"""
)
def hybrid_rank(spark, sf_dir):
    target = F.array(*[F.lit(float(x)) for x in _first_vector(spark, sf_dir)])
    signals = _table(spark, sf_dir, "embeddings").select("vec_id", vectors.cosine(F.col("embedding"), target).alias("vector"), (F.col("vec_id") % 7 / 7).alias("text"), (F.col("label") / 10).alias("structure"), (F.col("vec_id") % 11 / 11).alias("recency"), F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(0.0).alias("validity"))
    return signals.select("vec_id", F.round(retrieval.hybrid_score(), 6).alias("score"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}) DESC, vec_id LIMIT 10")
def vector_knn(spark, sf_dir):
    return _rounded(vector.knn(_table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10))


@query(
    """SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id WHERE list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.3"""
)
def cosine_pairs(spark, sf_dir):
    """The stated query set: every vector whose id is divisible by 50, against all vectors."""
    rows = _table(spark, sf_dir, "embeddings")
    return _rounded(vector.pairs_above(rows, rows.filter("vec_id % 50 = 0"), 0.3))


# -- graph


def _graph_edges(spark, sf_dir):
    people = _table(spark, sf_dir, "customer").selectExpr("c_custkey + 1000 as a", "cast(c_nationkey + 100 as long) as b")
    lands = _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey + 100 as long) as a", "cast(n_regionkey + 1 as long) as b")
    return people, lands


_GRAPH_SQL = "e AS (SELECT c_custkey + 1000 AS a, c_nationkey + 100 AS b FROM customer UNION ALL SELECT n_nationkey + 100, n_regionkey + 1 FROM nation)"
#: Every customer hangs on a nation and every nation on a region, whose node is the smallest.
_LABELS_SQL = """labels AS (SELECT c_custkey + 1000 AS node, n_regionkey + 1 AS component FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 1 FROM nation UNION ALL SELECT DISTINCT n_regionkey + 1, n_regionkey + 1 FROM nation)"""


@query(
    f"""WITH RECURSIVE {_GRAPH_SQL}, both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (SELECT a AS node, a AS seed FROM both_ways UNION SELECT w.b, walk.seed FROM walk JOIN both_ways w ON w.a = walk.node WHERE walk.seed <= 5)
SELECT node::BIGINT AS node, min(seed)::BIGINT AS component FROM walk GROUP BY node"""
)
def components(spark, sf_dir):
    people, lands = _graph_edges(spark, sf_dir)
    return graph.connected_components(people.union(lands))


@query(f"WITH {_LABELS_SQL} SELECT node::BIGINT AS node, component::BIGINT AS component FROM labels WHERE node IN (1, 100, 1000, 1007) UNION ALL SELECT 99999999, NULL")
def community_of(spark, sf_dir):
    people, lands = _graph_edges(spark, sf_dir)
    asked = spark.createDataFrame([(n,) for n in (1, 100, 1000, 1007, 99999999)], "node long")
    return graph.community_of(graph.connected_components(people.union(lands)), asked)


@query(f"WITH {_LABELS_SQL} SELECT component::BIGINT AS id, count(*) AS n_members, min(node)::BIGINT AS first, max(node)::BIGINT AS last, 0 AS level FROM labels GROUP BY component")
def communities(spark, sf_dir):
    people, lands = _graph_edges(spark, sf_dir)
    found = graph.communities(graph.connected_components(people.union(lands)))
    return found.select("id", F.size("members").cast("long").alias("n_members"), F.element_at("members", 1).alias("first"), F.element_at("members", -1).alias("last"), "level")


@query(f"WITH {_LABELS_SQL} SELECT node::BIGINT AS node, component::BIGINT AS component FROM labels")
def community_incremental(spark, sf_dir):
    people, lands = _graph_edges(spark, sf_dir)
    return graph.extend_components(graph.connected_components(people), lands)


@query(
    f"""WITH {_LABELS_SQL}, names AS (SELECT c_custkey + 1000 AS node, c_name AS name FROM customer UNION ALL SELECT n_nationkey + 100, n_name FROM nation UNION ALL SELECT r_regionkey + 1, r_name FROM region),
m AS (SELECT component, count(*) AS n, string_agg(name, ', ' ORDER BY node) AS members FROM labels JOIN names USING (node) GROUP BY component),
f AS (SELECT l.component, string_agg(c_name || ' lives_in ' || n_name, '; ' ORDER BY c_custkey) AS told FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN labels l ON l.node = c_custkey + 1000 WHERE c_custkey % 5 = 0 GROUP BY l.component)
SELECT m.component::BIGINT AS id, 'Community of ' || n || ' entities (' || members || '). Current facts: ' || coalesce(told, 'none') AS summary FROM m LEFT JOIN f USING (component)"""
)
def community_summaries(spark, sf_dir):
    """Summaries where only every fifth customer's residence is still current."""
    people, lands = _graph_edges(spark, sf_dir)
    rows, nations = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    names = rows.selectExpr("c_custkey + 1000 as node_id", "c_name as name").union(nations.selectExpr("cast(n_nationkey + 100 as long)", "n_name")).union(_table(spark, sf_dir, "region").selectExpr("cast(r_regionkey + 1 as long)", "r_name"))
    told = rows.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey as edge_id", "cast(0 as long) as tenant", "c_custkey + 1000 as subject_id", "c_name as subject", "'lives_in' as predicate", "n_name as object", "cast(0 as long) as valid_from", "case when c_custkey % 5 <> 0 then cast(9 as long) end as valid_to", "cast(0 as long) as tx_from", "cast(null as long) as tx_to")
    return graph.community_summaries(told, names, graph.connected_components(people.union(lands))).select("id", "summary")


@query(
    """WITH hops AS (SELECT 'n:0' AS node, 0 AS hops UNION ALL SELECT 'c:' || c_custkey, 1 FROM customer WHERE c_nationkey = 0
  UNION ALL SELECT 'r:' || n_regionkey, 1 FROM nation WHERE n_nationkey = 0
  UNION ALL SELECT 'n:' || b.n_nationkey, 2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey <> 0 WHERE a.n_nationkey = 0)
SELECT node, hops FROM hops"""
)
def expand_bfs(spark, sf_dir):
    span = ("cast(0 as long) as valid_from", "cast(null as long) as valid_to", "cast(0 as long) as tx_from", "cast(null as long) as tx_to")
    people = _table(spark, sf_dir, "customer").selectExpr("concat('c:', c_custkey) as subject", "concat('n:', c_nationkey) as object", *span)
    lands = _table(spark, sf_dir, "nation").selectExpr("concat('n:', n_nationkey) as subject", "concat('r:', n_regionkey) as object", *span)
    seeds = spark.createDataFrame([("n:0",)], "node string")
    return graph.expand(people.union(lands), seeds, 2)


# -- entities

_FORM = r"array_to_string(list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: t <> '' AND t NOT IN ('inc', 'llc', 'ltd', 'corp', 'co', 'the')), ' ')"
_VARIANT = "CASE WHEN p_partkey % 3 = 0 THEN 'The ' || p_name || ', Inc.' ELSE p_name END"


def _entities(spark, sf_dir):
    return _table(spark, sf_dir, "part").selectExpr("p_partkey as node_id", "case when p_partkey % 3 = 0 then concat('The ', p_name, ', Inc.') else p_name end as name")


def _distinct_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("node_id"))


_PAIRS_SQL = f"""names AS (SELECT p_name AS name, min(p_partkey) AS node_id FROM part GROUP BY p_name), forms AS (SELECT node_id, {_FORM.format("name")} AS form FROM names),
pairs AS (SELECT a.node_id AS lo, b.node_id AS hi, CASE WHEN a.form = '' OR b.form = '' THEN 0 WHEN a.form = b.form THEN 1 ELSE
  len(list_intersect(string_split(a.form, ' '), string_split(b.form, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(a.form, ' '), string_split(b.form, ' ')))) END AS score
  FROM forms a JOIN forms b ON a.node_id < b.node_id)"""


@query(f"SELECT p_partkey AS node_id, {_FORM.format(_VARIANT)} AS form FROM part")
def normalize_names(spark, sf_dir):
    return _entities(spark, sf_dir).select("node_id", text.normalize_name(F.col("name")).alias("form"))


@query(f"WITH {_PAIRS_SQL} SELECT lo, hi, round(score, 6) AS score FROM pairs WHERE score >= 0.3")
def name_pairs(spark, sf_dir):
    return _rounded(resolution.candidate_pairs(_distinct_names(spark, sf_dir), 0.3))


@query(f"WITH {_PAIRS_SQL} SELECT CASE WHEN lo = 0 THEN hi ELSE lo END AS node_id, round(score, 6) AS score FROM pairs WHERE score >= 0.3 AND (lo = 0 OR hi = 0)")
def node_candidates(spark, sf_dir):
    return _rounded(resolution.candidates_of(_distinct_names(spark, sf_dir), 0, 0.3))


_SURVIVORS_SQL = f"forms AS (SELECT p_partkey AS node, {_FORM.format(_VARIANT)} AS form FROM part), groups AS (SELECT node, min(node) OVER (PARTITION BY form) AS survivor, count(*) OVER (PARTITION BY form) AS n FROM forms)"


@query(f"WITH {_SURVIVORS_SQL} SELECT node, survivor FROM groups WHERE n > 1")
def auto_resolve(spark, sf_dir):
    return resolution.survivors(resolution.resolution_links(_entities(spark, sf_dir), 0.9))


_MERGE_SQL = f"""{_SURVIVORS_SQL}, f AS (SELECT p_partkey + 1 AS edge_id, p_partkey AS subject_id, 1000000 + CAST(substr(p_brand, 7) AS BIGINT) AS object_id FROM part),
moved AS (SELECT edge_id, survivor AS subject_id, object_id, survivor <> subject_id AS touched FROM f JOIN groups ON node = subject_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY subject_id, object_id ORDER BY @ORDER@) AS n FROM moved)
SELECT edge_id, subject_id, object_id FROM numbered WHERE NOT touched OR n = 1"""


def _merged(spark, sf_dir, compat):
    """Brands are nodes of their own, below zero while parts are merged: a part's key may be any number from zero on."""
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey + 1 as edge_id", "cast(0 as long) as tenant", "p_partkey as subject_id", "cast(1 as long) as predicate_id", "-(1000000 + cast(substr(p_brand, 7) as long)) as object_id", "cast(0 as long) as valid_from")
    labels = resolution.survivors(resolution.resolution_links(_entities(spark, sf_dir), 0.9))
    return resolution.merge_facts(rows, labels, compat).select("edge_id", "subject_id", (-F.col("object_id")).alias("object_id"))


@query(f"WITH {_MERGE_SQL.replace('@ORDER@', 'touched, edge_id')}")
def merge_facts(spark, sf_dir):
    return _merged(spark, sf_dir, False)


@query(f"WITH {_MERGE_SQL.replace('@ORDER@', 'edge_id & 255, (edge_id >> 8) & 255, (edge_id >> 16) & 255, edge_id >> 24')}")
def merge_facts_scan_order(spark, sf_dir):
    return _merged(spark, sf_dir, True)


@query("SELECT 'wide' AS name, CAST(1536 AS BIGINT) AS dim")
def model_registry(spark, sf_dir):
    log = spark.createDataFrame([("small", 64, 1), ("wide", 1536, 2), ("small", 64, 3)], "name string, dim long, reg_seq long")
    return vector.active_model(log)


# -- the language

_SOURCES = [
    "",
    QUESTION,
    "MATCH (n) RETURN n",
    "AS OF TRANSACTION TIME 42 RETURN CONTEXT(cite = false)",
    "MATCH ( <bad",
    'AS OF VALID TIME 5 WHERE SIMILAR(n,"x") RETURN CONTEXT(cite=true)',
    'WHERE foo = 3 AND SIMILAR(n,"x") RETURN n',
    "MATCH (u:User) RETURN u",
    "TRAVERSE SEMANTIC(depth <= -1, budget = -3)",
]


_PARSED_SQL = f"""SELECT source, error, similar_to, CAST(valid_time AS VARCHAR) AS valid_time, CAST(tx_time AS VARCHAR) AS tx_time,
  CAST(depth AS VARCHAR) AS depth, CAST(budget AS VARCHAR) AS budget, CAST(cite AS VARCHAR) AS cite, names
FROM (VALUES
  ('', NULL, NULL, {MAX}, {MAX}, NULL, NULL, false, ''),
  ('{QUESTION}', NULL, 'user 8 purchase', {AT}, {MAX}, NULL, 40, true, ''),
  ('MATCH (n) RETURN n', NULL, NULL, {MAX}, {MAX}, NULL, NULL, false, 'n'),
  ('AS OF TRANSACTION TIME 42 RETURN CONTEXT(cite = false)', NULL, NULL, {MAX}, 42, NULL, NULL, false, ''),
  ('MATCH ( <bad', 'query error: unexpected ''<'' at 8', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('AS OF VALID TIME 5 WHERE SIMILAR(n,"x") RETURN CONTEXT(cite=true)', NULL, NULL, 5, {MAX}, NULL, NULL, false, ''),
  ('WHERE foo = 3 AND SIMILAR(n,"x") RETURN n', NULL, 'x', {MAX}, {MAX}, NULL, NULL, false, 'n'),
  ('MATCH (u:User) RETURN u', 'query error: unexpected '':'' at 8', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('TRAVERSE SEMANTIC(depth <= -1, budget = -3)', NULL, NULL, {MAX}, {MAX}, 4294967295, 0, false, '')
) AS t(source, error, similar_to, valid_time, tx_time, depth, budget, cite, names)"""


@query(_PARSED_SQL)
def parsed_query_matrix(spark, sf_dir):
    """What the parser makes of some texts; numbers and flags as text, null where there is none."""
    rows = []
    for source in _SOURCES:
        try:
            q = parse(source)
            at = q.as_of or AsOf.now()
            rows.append((source, None, q.similar_to, at.valid_time, at.tx_time, q.max_depth, q.budget, q.cite, ",".join(q.return_names)))
        except QueryError as error:
            rows.append((source, str(error), None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, "source string, error string, similar_to string, valid_time long, tx_time long, depth long, budget long, cite boolean, names string").selectExpr("source", "error", "similar_to", *[f"cast({c} as string) as {c}" for c in ("valid_time", "tx_time", "depth", "budget", "cite")], "names")


def answer_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: text to query to context."""
    return plans.answer(QUESTION, event_facts(spark, sf_dir))
