"""BM25 over any (key, text) table.

For a query of few terms nothing is shuffled: every text is cut once, whatever the number of terms, into
its length and those of its tokens that the query has, one aggregate gives the corpus statistics, and
those, a single row, are joined back. For many queries :func:`postings` keeps an inverted table, partitioned by term.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import term_count, tokens

# Fixed values of the scoring formula.
K1, B = 1.5, 0.75


def query_terms(query: str) -> list[str]:
    """The query's tokens, repeats included, as the column expression would cut them."""
    return regex.findall(r"[\p{Alphabetic}\p{N}]+", query.lower())


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column whose value is worked out once a row: the optimizer does not copy it into what uses it."""
    return df.withColumn(name, F.explode(F.array(value)))


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def _weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(corpus: DataFrame, query: str, key: str = "key", text: str = "text") -> DataFrame:
    """(key, score) of the texts that hold a term of the query. Repeated terms count repeatedly; an empty
    query or corpus gives no rows; texts without tokens count in the corpus statistics."""
    terms = query_terms(query)
    distinct = list(dict.fromkeys(terms))
    if not distinct:
        return corpus.select(F.col(key).alias("key"), F.lit(0.0).alias("score")).filter(F.lit(False))
    words = _once(corpus.select(F.col(key).alias("key"), F.col(text).alias("text")), "words", tokens(F.col("text")))
    asked = F.filter("words", lambda t: t.isin(distinct))
    cut = _once(words, "cut", F.struct(F.size("words").alias("dl"), asked.alias("hits"))).select("key", "cut.dl", "cut.hits")
    counted = cut.select("key", "dl", *[term_count(F.col("hits"), t).alias(f"tf{i}") for i, t in enumerate(distinct)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(distinct))])
    met = counted.filter(F.greatest(F.lit(0), *[F.col(f"tf{i}") for i in range(len(distinct))]) > 0).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, term in enumerate(distinct):
        score = score + F.lit(terms.count(term)) * _idf(F.col("n"), F.col(f"df{i}")) * _weight(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"))
    return met.select("key", score.alias("score"))


def search(corpus: DataFrame, query: str, k: int, key: str = "key", text: str = "text") -> DataFrame:
    """The ``k`` best texts, ties by key."""
    return bm25(corpus, query, key, text).orderBy(F.desc("score"), "key").limit(k)


def postings(corpus: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """The inverted table (term, key, tf, dl), for many queries over one corpus."""
    words = _once(corpus.select(F.col(key).alias("key"), F.col(text).alias("text")), "words", tokens(F.col("text")))
    counted = words.select("key", F.size("words").alias("dl"), F.explode("words").alias("term"))
    return counted.groupBy("term", "key", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(corpus: DataFrame, text: str = "text") -> DataFrame:
    """One row: n texts, total and mean length in tokens (0 for an empty corpus)."""
    sized = _once(corpus.select(F.col(text).alias("text")), "dl", F.size(tokens(F.col("text"))))
    return sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_len"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def bm25_postings(index: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """(key, score) from an inverted table: reads the query's terms alone."""
    terms = query_terms(query)
    if not terms:
        return index.select("key", F.lit(0.0).alias("score")).filter(F.lit(False))
    weight = F.create_map(*[x for t in dict.fromkeys(terms) for x in (F.lit(t), F.lit(terms.count(t)))])
    mine = index.filter(F.col("term").isin(*set(terms)))
    df = mine.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    met = mine.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row per query term; one row
    part = weight[F.col("term")] * _idf(F.col("n"), F.col("df")) * _weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return met.groupBy("key").agg(F.sum(part).alias("score"))


def reindex(corpus: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """The corpus with texts replaced or added; a change with a null text removes the key."""
    rest = corpus.join(changes.select(key), key, "left_anti")
    return rest.unionByName(changes.filter(F.col("text").isNotNull()).select(*corpus.columns))
