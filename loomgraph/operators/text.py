"""Full-text search over an inverted index kept as a DataFrame of postings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.expr import tokens
from loomgraph.operators import lookup

NODE_FIELDS = ("name", "qualified_name", "signature", "doc_comment")
K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """token, id, col, pos (from 0): one row per word; null texts have none."""
    parts = F.explode(F.array(*[F.struct(F.lit(x).alias("col"), tokens(x).alias("ts")) for x in cols])).alias("f")
    return docs.select(F.col(key).alias("id"), parts).select("id", "f.col", F.posexplode("f.ts").alias("pos", "token")).select("token", "id", "col", "pos")


@dataclass(frozen=True)
class Query:
    """``mode`` 'any' or 'all' of ``terms`` (word, is_prefix), or a 'phrase'; 'substring' for texts
    that the index can't split into words."""

    mode: str
    terms: tuple[tuple[str, bool], ...] = field(default=())
    #: Columns that all words must stand in; empty means any.
    cols: tuple[str, ...] = field(default=())


def _words(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", s.lower())


def rewrite(text: str) -> Query:
    """How a search box's text is read.

    Anything outside ASCII goes to substring search.  Quotes, stars, brackets or colons mean the text
    is a query as it stands: a quoted phrase, or all of its words, starred ones as prefixes; ``name: word`` or
    ``{name signature}: word`` keeps to these columns.  One word
    of two letters or more is a prefix; of several, those shorter than three are dropped, those of
    four or more are prefixes, and any may match.  If none is left the words stay as they are.
    Punctuation only separates words.
    """
    if not text.isascii():
        return Query("substring", ((text, False),))
    if m := re.fullmatch(r"\s*\{?\s*((?:" + "|".join(NODE_FIELDS) + r")(?:\s+(?:" + "|".join(NODE_FIELDS) + r"))*)\s*\}?\s*:(?!:)\s*(.+)", text):
        rest = rewrite(m.group(2))
        # what follows a filter is a query as it stands, so a lone word isn't widened to a prefix
        terms = rest.terms if "*" in m.group(2) else tuple((w, False) for w, _ in rest.terms)
        return Query("phrase" if rest.mode == "phrase" else "all", terms, tuple(m.group(1).split()))
    if m := re.fullmatch(r'\s*"([^"]*)"\s*', text):
        return Query("phrase", tuple((w, False) for w in _words(m.group(1))))
    if re.search(r'[*"():]', text):
        terms = [(w.lower(), star == "*") for w, star in re.findall(r"([^\W_]+)(\*?)", text) if w.upper() not in ("AND", "OR", "NOT")]
        return Query("any" if re.search(r"\bOR\b", text) else "all", tuple(terms))
    fields = text.split()
    if len(fields) == 1:
        ws = _words(fields[0])
        return Query("all" if len(ws) > 1 else "any", tuple((w, len(w) >= 2) for w in ws))
    kept = [w for f in fields for w in _words(f) if len(w) >= 3]
    if not kept:
        return Query("all", tuple((w, False) for f in fields for w in _words(f)))
    return Query("any", tuple((w, len(w) >= 4) for w in kept))


def _hits(index: DataFrame, terms: Sequence[tuple[str, bool]]) -> DataFrame:
    """Postings of any of the terms, with ``term``, the number of the term they match."""
    parts = None
    for i, (w, prefix) in enumerate(terms):
        t = F.col("token")
        hit = index.where(t.startswith(w) if prefix else t == w).withColumn("term", F.lit(i))
        parts = hit if parts is None else parts.unionByName(hit)
    return index.limit(0).withColumn("term", F.lit(0)) if parts is None else parts


def match(index: DataFrame, query: Query) -> DataFrame:
    """Distinct ids that match."""
    if query.cols:
        index = index.where(F.col("col").isin(*query.cols))
    if query.mode == "any":
        return _hits(index, query.terms).select("id").distinct()
    if query.mode == "all":
        h = _hits(index, query.terms).groupBy("id").agg(F.countDistinct("term").alias("n"))
        return h.where(F.col("n") == len(query.terms)).select("id") if query.terms else h.select("id")
    if query.mode == "phrase":
        # a phrase begins where all its words, each shifted by its place, meet
        h = _hits(index, query.terms).select("id", "col", (F.col("pos") - F.col("term")).alias("start"), "term")
        g = h.groupBy("id", "col", "start").agg(F.countDistinct("term").alias("n"))
        return g.where(F.col("n") == len(query.terms)).select("id").distinct()
    raise ValueError(query.mode)


def bm25(index: DataFrame, terms: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
    """id, score: the sum over terms of idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)).

    Lengths and the numbers behind idf are aggregates of the index; the two corpus numbers are scalars.
    """
    words = sorted({w for t in terms for w in _words(t)})
    dl = index.groupBy("id").agg(F.count(F.lit(1)).alias("dl"))
    corpus = dl.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    hit = index.where(F.col("token").isin(*words)) if words else index.limit(0)
    tf = hit.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(corpus.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(corpus.avgdl or 1.0)))
    return tf.join(df, "token").join(dl, "id").groupBy("id").agg(F.round(F.sum(part), 9).alias("score"))


def search(nodes: DataFrame, index: DataFrame, text: str, limit: int = 20, rank: str = "bm25", language: str | None = None) -> DataFrame:
    """Nodes for a search box's text: id, rank (from 1) and the node's columns.  ``rank`` 'bm25' or
    'id' (order of ids).  An empty text finds nothing."""
    q = rewrite(text)
    if language:
        nodes = nodes.where(F.col("language") == language)
    if q.mode == "substring":
        ids = nodes.where(F.col("name").contains(text) | F.col("qualified_name").contains(text)).select("id", F.lit(0.0).alias("score"))
    else:
        found = match(index, q)
        ids = found.withColumn("score", F.lit(0.0))
        if rank == "bm25" and q.terms:
            ids = found.join(bm25(index, [w for w, _ in q.terms]), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
        ids = ids.join(nodes.select("id"), "id", "left_semi")
    top = ids.orderBy(F.desc("score"), "id").limit(limit)
    from pyspark.sql import Window

    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # at most ``limit`` rows
    return lookup.nodes_by_ids(nodes, ranked).join(ranked.select("id", "rank"), "id")
