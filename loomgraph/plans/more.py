"""Queries of sources, build, style and evaluation operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import evaluate
from loomgraph.operators import community, lookup, resolve, style, text, traverse
from loomgraph.plans.reference import _CM, _CP, _DP, _HOP, _PR, _R2, _SEARCH, _TASK, N, NE, SEEDS, SRC, _g, _index, _members, _ordered, _pending, _qname, _top
from loomgraph.sources import store, tree
from loomgraph.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


# --- sources --------------------------------------------------------------------------------------


@query("SELECT DISTINCT file_path FROM source_files WHERE lower(regexp_extract(file_path, '\\.[^./]*$')) IN ('.go', '.sol')")
def language_gate(spark, d):
    return tree.source_files(table(spark, d, "source_files", "file_path").distinct(), languages=["go", "sol"]).select("file_path")


@query("SELECT file_path, least(4000, octet_length(encode(content))) AS n_bytes FROM (SELECT file_path, any_value(content) AS content FROM source_files GROUP BY 1 ORDER BY string_split(file_path, '/') LIMIT 5)")
def file_dump(spark, d):
    """The first five files in walk order, cut to 4,000 bytes; the limit is the feature."""
    f = table(spark, d, "source_files", "file_path", "content").dropDuplicates(["file_path"]).withColumn("content", F.encode("content", "UTF-8"))
    return tree.dump(f).select("file_path", F.octet_length("content").alias("n_bytes"))


@query("SELECT list(file_path ORDER BY file_path) AS files, CAST(sum(epoch_us(m) * 1000) AS BIGINT) AS mtime_sum FROM (SELECT file_path, max(committed_at) AS m FROM source_files GROUP BY 1 ORDER BY string_split(file_path, '/') LIMIT 5)")
def fingerprint(spark, d):
    return tree.fingerprint(table(spark, d, "source_files", "file_path", "committed_at").groupBy("file_path").agg(F.max("committed_at").alias("modified")))


@query(f"{NE} SELECT row_number() OVER (ORDER BY src, dst, type, line NULLS FIRST, file_path NULLS FIRST, count, confidence) AS id, src, dst, type, coalesce(line, -1) AS line FROM e")
def edge_numbers(spark, d):
    return store.number_edges(_g(spark, d).edges.select("id", "src", "dst", "type", "line", "file_path", "count", "confidence")).select("id", "src", "dst", "type", F.coalesce("line", F.lit(-1)).alias("line"))


# --- lookups and traversals -----------------------------------------------------------------------


@query("SELECT * FROM (VALUES (-1, 5000), (0, 5000), (1, 1), (50000, 50000), (50001, 5000)) t(asked, given)")
def limit_clamp(spark, d):
    return spark.createDataFrame([(x, lookup.clamp(x)) for x in (-1, 0, 1, 50_000, 50_001)], "asked int, given int")


@query("WITH c AS (SELECT child_id FROM pkg_tree WHERE child_id IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT parent_id) DESC, 1 LIMIT 1) SELECT parent_id, level FROM pkg_tree WHERE child_id = (SELECT child_id FROM c)")
def parents_of(spark, d):
    t = table(spark, d, "pkg_tree")
    c = t.where("child_id is not null").groupBy("child_id").agg(F.countDistinct("parent_id").alias("k")).orderBy(F.desc("k"), "child_id").limit(1).collect()
    return lookup.parents_of(t, c[0].child_id if c else "").select("parent_id", "level")


@query(f"{NE} SELECT e.id, src, dst, type FROM e WHERE src IN (SELECT id FROM n WHERE type = 'Package') AND type IN ('contains', 'defines')")
def edges_from_nodes(spark, d):
    g = _g(spark, d)
    return lookup.edges_from(g.edges, g.nodes.where("type = 'Package'").select("id"), ["contains", "defines"]).select("id", "src", "dst", "type")


@query(f"WITH {N} SELECT id, 0 AS depth FROM n WHERE type = 'Package' ORDER BY id LIMIT 500")
def visible_roots(spark, d):
    """What a viewer shows without an anchor; the limit is the viewer's."""
    g = _g(spark, d)
    return traverse.visible_set(g.nodes, g.edges, None, 3)


@query(
    f"{NE}, {SRC}, {SEEDS}, {_R2.format('rf', 'src', 'dst')}, {_R2.format('rb', 'dst', 'src')}, lf AS (SELECT id, min(d) AS d FROM rf GROUP BY 1), lb AS (SELECT id, min(d) AS d FROM rb GROUP BY 1)"
    " SELECT e.id, src, dst, type FROM e JOIN lf ON lf.id = e.src WHERE lf.d < 2 UNION ALL SELECT e.id, src, dst, type FROM e JOIN lb ON lb.id = e.dst WHERE lb.d < 2"
)
def subgraph_d2_edges(spark, d):
    """Edges of both directions as a bag: an edge that both follow comes twice."""
    g = _g(spark, d)
    return traverse.subgraph(g.nodes, g.edges, _qname(g, _top(g, "src")), 2).edges.select("id", "src", "dst", "type")


@query(f"{_HOP}, vis AS (SELECT h.id FROM h WHERE id IN (SELECT id FROM n) ORDER BY depth, id LIMIT 500), {_SEARCH.replace('), m AS', '), m AS', 1)} SELECT id FROM vis UNION SELECT id FROM cand")
def visible_with_hits(spark, d):
    g = _g(spark, d)
    return traverse.visible_with_hits(traverse.visible_set(g.nodes, g.edges, _top(g, "src"), 3), text.search(g.nodes, _index(g), _TASK, 30))


@query(f"WITH {N}, p AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(doc_comment, '')), '[\\p{{L}}\\p{{N}}]+')) AS token FROM n) SELECT DISTINCT id FROM p WHERE token = 'ledger'")
def search_column(spark, d):
    return text.match(_index(_g(spark, d)), text.rewrite("doc_comment: ledger"))


@query(f"WITH {N} SELECT id, 1 AS found FROM n WHERE contains(doc_comment, '항목') ORDER BY id LIMIT 20")
def search_route_cjk(spark, d):
    """The route of words outside ASCII, with documentation in the place of names, which hold none; 20 is the search's own limit."""
    g = _g(spark, d)
    docs = g.nodes.withColumn("name", F.coalesce("doc_comment", F.lit(""))).withColumn("qualified_name", F.col("name"))
    return text.search(docs, _index(g), "항목").select("id", F.lit(1).alias("found"))


# --- style ----------------------------------------------------------------------------------------


def _case(key: str, values: dict, default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {default} END"


@query(f"WITH {N} SELECT id, {_case('language', style.LANGUAGE_COLOUR)} AS colour, {_case('type', style.SHAPE)} AS shape FROM n")
def node_style(spark, d):
    return style.node_style(_g(spark, d).nodes)


_ES = [{k: v[i] for k, v in style.EDGE_STYLE.items()} for i in range(3)]


@query(f"{NE} SELECT id, {_case('type', _ES[0], str(style.PLAIN_EDGE[0]))} AS colour, {_case('type', _ES[1], '1')} AS width, {_case('type', _ES[2], 'false')} AS dashed FROM e WHERE type <> 'contains'")
def edge_style(spark, d):
    return style.edge_style(_g(spark, d).edges)


@query(f"{_HOP} SELECT e.id, CASE least(greatest(coalesce(a.depth, 3), coalesce(b.depth, 3)), 3) WHEN 2 THEN 0.55::DOUBLE WHEN 3 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS brightness FROM e LEFT JOIN h a ON a.id = e.src LEFT JOIN h b ON b.id = e.dst")
def edge_brightness(spark, d):
    g = _g(spark, d)
    return style.edge_brightness(g.edges, traverse.hop_distance(g.edges, g.nodes.where(F.col("id") == _top(g, "src")).select("id"), 3))


# --- resolution and build -------------------------------------------------------------------------


@query(
    f"WITH {N}, w AS (SELECT id, type, name, last_value(CASE WHEN type = 'Contract' THEN name END IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY start_byte, id ROWS UNBOUNDED PRECEDING) AS contract FROM n WHERE language = 'sol' AND type IN ('Contract', 'Function')) SELECT id, contract, name AS function FROM w WHERE type = 'Function' AND contract IS NOT NULL"
)
def abi_functions(spark, d):
    return resolve.abi(_g(spark, d).nodes)


# references to what Solidity functions use are made of the functions' calls: every other target's simple name stands
# for an event or a mapping, which are declared as nodes under these names
_USED = """us AS (SELECT e.src AS src_id, split_part(t.qualified_name, '.', -1) AS nm, e.line, t.start_byte % 2 AS odd FROM e JOIN n t ON t.id = e.dst WHERE e.type = 'calls' AND t.language = 'sol'),
dc AS (SELECT id, file_path, start_byte, name AS nm, start_byte % 2 AS odd FROM n WHERE language = 'sol' AND type = 'Function')"""


@query(
    f"""{NE}, {_USED}, ix AS (SELECT odd, nm, arg_min(id, (file_path, start_byte, id)) AS dst, arg_min(file_path, (file_path, start_byte, id)) AS df FROM dc GROUP BY 1, 2)
SELECT src_id AS src, dst, CASE WHEN us.odd = 1 THEN 'emits_event' ELSE 'writes_mapping' END AS type, us.line, 1 AS count, CASE WHEN s.file_path IS NOT DISTINCT FROM df THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence FROM us JOIN ix USING (odd, nm) LEFT JOIN (SELECT id, file_path FROM dc) s ON s.id = src_id"""
)
def resolve_events_mappings(spark, d):
    g = _g(spark, d)
    sol = _ordered(g, "sol").where("type = 'Function'")
    odd = F.col("start_byte") % 2 == 1
    declared = sol.withColumn("type", F.when(odd, "Event").otherwise("Mapping"))
    t = g.nodes.where("language = 'sol'").select(F.col("id").alias("dst"), F.substring_index("qualified_name", ".", -1).alias("nm"), odd.alias("odd"))
    used = g.edges.where("type = 'calls'").select(F.col("src").alias("src_id"), "dst", "line").join(t, "dst")
    pending = used.select("src_id", F.when(F.col("odd"), "emits_event").otherwise("writes_mapping").alias("edge_type"), F.when(F.col("odd"), F.col("nm")).otherwise(F.concat("nm", F.lit(":mapping"))).alias("target_qname"), "line")
    return resolve.resolve_sol(pending, declared)


@query(
    f"""WITH {N}, cl AS (SELECT name, file_path, id FROM n WHERE type = 'Class' AND language = 'ts'), ct AS (SELECT DISTINCT 'contract ' || name AS id, name FROM cl)
SELECT ct.id AS src, arg_min(cl.id, (-(contains(lower(file_path), 'typechain')::INT + contains(lower(file_path), 'contracts')::INT + contains(lower(file_path), 'abi')::INT), cl.id)) AS dst, 'binds_to' AS type, 1 AS count, 'INFERRED' AS confidence FROM ct JOIN cl USING (name) GROUP BY 1"""
)
def xlang_link(spark, d):
    """Contracts are added under the names of classes, so that there is something to bind."""
    n = _g(spark, d).nodes
    made = n.where("type = 'Class' and language = 'ts'").select("name").distinct().select(F.concat(F.lit("contract "), "name").alias("id"), "name", F.lit("Contract").alias("type"), F.lit("sol").alias("language"), F.lit("").alias("file_path"))
    return resolve.link_contracts(n.select("id", "name", "type", "language", "file_path").unionByName(made))


@query(f"{NE} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM pkg_tree) AS n_pkg_edges, (SELECT CAST(sum(try_cast(value AS BIGINT)) AS BIGINT) FROM manifest WHERE key = 'parse_errors_count') AS n_errors")
def build_totals(spark, d):
    g = _g(spark, d)
    one = [g.nodes.agg(F.count(F.lit(1)).alias("n_nodes")), g.edges.agg(F.count(F.lit(1)).alias("n_edges")), table(spark, d, "pkg_tree").agg(F.count(F.lit(1)).alias("n_pkg_edges"))]
    errors = table(spark, d, "manifest").where("key = 'parse_errors_count'").agg(F.sum(F.expr("try_cast(value as bigint)")).alias("n_errors"))
    out = errors.withColumn("k", F.lit(1))
    for x in one:  # one row each
        out = out.join(x.withColumn("k", F.lit(1)), "k")
    return out.drop("k")


# --- communities ----------------------------------------------------------------------------------


@query(
    f"""{NE}, {_CP}, {_CM}, j AS (SELECT w, x.comm AS ca, y.comm AS cb FROM cp JOIN cm x ON x.id = a JOIN cm y ON y.id = b),
k AS (SELECT comm, sum(i) AS i, sum(w) AS k FROM (SELECT ca AS comm, CASE WHEN ca = cb THEN w ELSE 0 END AS i, w FROM j UNION ALL SELECT cb, 0, w FROM j) GROUP BY 1)
SELECT round(2.0 * sum(i) / sum(k) - sum(k::DOUBLE * k) / (sum(k)::DOUBLE * sum(k)), 9) AS modularity FROM k"""
)
def community_modularity(spark, d):
    g = _g(spark, d)
    return community.modularity(community.community_edges(g.edges), _members(g).select("id", "comm")).select(F.round("modularity", 9).alias("modularity"))


@query(f"WITH {N}, {_CM} SELECT comm, row_number() OVER (ORDER BY f, comm) - 1 AS label FROM (SELECT comm, min(id) AS f FROM cm GROUP BY comm)")
def community_dense_labels(spark, d):
    return community.dense_labels(_members(_g(spark, d)).select("id", "comm"))


_PX = """t3 AS (SELECT comm, list(name ORDER BY name, id) AS ns FROM (SELECT comm, name, id, row_number() OVER (PARTITION BY comm ORDER BY name, id) AS rn FROM n JOIN cm USING (id)) WHERE rn <= 3 GROUP BY comm HAVING count(*) = 3),
px AS (SELECT comm, list_reduce(list_prepend('', list_transform(range(1, CAST(least(length(ns[1]), length(ns[2]), length(ns[3])) AS BIGINT) + 1), lambda i: CASE WHEN substr(ns[1], 1, i) = substr(ns[2], 1, i) AND substr(ns[1], 1, i) = substr(ns[3], 1, i) THEN substr(ns[1], 1, i) ELSE '' END)), lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) AS prefix FROM t3)"""


@query(
    f"""WITH {N}, {_CM}, {_DP}, {_PX}, tm AS (SELECT comm, arg_min(name, (-coalesce({_PR}, 0), id)) AS top FROM n JOIN cm USING (id) GROUP BY comm),
l AS (SELECT comm, pk, CASE WHEN octet_length(encode(prefix)) >= 3 THEN prefix || '* + ' ELSE '' END || coalesce(top, '') AS tail FROM (SELECT DISTINCT comm FROM cm) LEFT JOIN dp USING (comm) LEFT JOIN px USING (comm) LEFT JOIN tm USING (comm))
SELECT comm, CASE WHEN pk IS NULL AND tail = '' THEN '(unnamed)' ELSE concat_ws(' — ', pk, nullif(tail, '')) END AS label FROM l"""
)
def community_labels(spark, d):
    return community.labels(_members(_g(spark, d)))


# --- evaluation -----------------------------------------------------------------------------------

_TASK_TEXT = """# a task
id: T7
corpus: mini
corpus_path: fixtures/mini
description: >
  which functions
  call Report
expected_kind: symbols
expected:
  symbols:
    - "store.Report"
    - store.Shelf.Add
  rubric:
    - "names the caller"
scoring:
  type: precision_recall
"""


@query("SELECT 'T7' AS id, 'mini' AS corpus, 'fixtures/mini' AS corpus_path, 'which functions call Report' AS description, 'symbols' AS expected_kind, ['store.Report', 'store.Shelf.Add'] AS symbols, ['names the caller'] AS rubric, 'precision_recall' AS scoring")
def task_fields(spark, d):
    t = evaluate.read_task(_TASK_TEXT)
    return spark.createDataFrame([(t.id, t.corpus, t.corpus_path, t.description, t.expected_kind, t.symbols, t.rubric, t.scoring)], "id string, corpus string, corpus_path string, description string, expected_kind string, symbols array<string>, rubric array<string>, scoring string")


_WANT = ("net.HashLeaf", "auth.CheckVault", "index.BuildVoucher", "api.SyncPacket")
_SYMS = "list_distinct(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[ ,\\n\"`]+'), lambda w: contains(w, '.') AND NOT starts_with(w, '.') AND NOT ends_with(w, '.')), lambda w: trim(w, '.:;()')))"
_SCORED = f"""sy AS (SELECT doc_id, kind, coalesce(n_chars, 0) AS n, lower(coalesce(text, '')) AS t, {_SYMS} AS g, {list(_WANT)} AS w FROM documents),
sc AS (SELECT doc_id, kind, n, CASE kind WHEN 'design' THEN (CASE WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, w)) / len(g) END + len(list_intersect(g, w)) / 4) / 2
 WHEN 'howto' THEN (((contains(t, 'keeps')::INT + contains(t, 'parser')::INT) >= 0.6 * 2)::INT + contains(t, 'retries')::INT) / 2 ELSE 0 END AS score FROM sy)"""


def _answers(spark, d):
    doc = table(spark, d, "documents", "doc_id", "kind", "text", "n_chars")
    how = F.when(F.col("kind") == "design", "precision_recall").when(F.col("kind") == "howto", "rubric").otherwise("none")
    rows = doc.select("doc_id", "kind", F.coalesce("n_chars", F.lit(0)).alias("n"), F.col("text").alias("output"), how.alias("scoring"), F.array(*[F.lit(x) for x in _WANT]).alias("symbols"), F.array(F.lit("keeps parser"), F.lit("retries")).alias("rubric"))
    return evaluate.score_answers(rows)


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM sc")
def score_tasks(spark, d):
    return _answers(spark, d).select("doc_id", F.round("score", 6).alias("score"))


_BASE = "CASE kind WHEN 'design' THEN 'alpha' WHEN 'howto' THEN 'delta' ELSE 'other' END"


def _results(spark, d):
    b = F.when(F.col("kind") == "design", "alpha").when(F.col("kind") == "howto", "delta").otherwise("other")
    zero = F.lit(0).cast("bigint")
    return _answers(spark, d).select(F.col("doc_id").cast("string").alias("task_id"), b.alias("baseline"), F.col("n").alias("input_tokens"), zero.alias("output_tokens"), zero.alias("cached_tokens"), "score", zero.alias("latency_ms"), zero.alias("num_tool_calls"), F.lit(False).alias("stale"))


@query(f"WITH {_SCORED}, a AS (SELECT avg(n) AS t, avg(score) AS s FROM sc WHERE {_BASE} = 'alpha'), d AS (SELECT avg(n) AS t, avg(score) AS s FROM sc WHERE {_BASE} = 'delta') SELECT round(100 * (1 - d.t / a.t), 6) AS h1_saving, round(d.s - a.s, 6) AS h2_difference, printf('%.1f%%', 100 * (1 - d.t / a.t)) AS h1_text, printf('%+.3f', d.s - a.s) AS h2_text FROM a, d")
def eval_hypotheses(spark, d):
    return evaluate.hypotheses(_results(spark, d)).select(F.round("h1_saving", 6).alias("h1_saving"), F.round("h2_difference", 6).alias("h2_difference"), "h1_text", "h2_text")


@query(f"WITH {_SCORED} SELECT CAST(doc_id AS VARCHAR) AS task_id, {_BASE} AS baseline, n AS input_tokens, printf('%.4f', score::DOUBLE) AS score FROM sc")
def results_csv(spark, d):
    return evaluate.csv_rows(_results(spark, d)).select("task_id", "baseline", "input_tokens", "score")
