"""Queries of the graph, retrieval and evaluation operators over the driver's tables, with their SQL.

Parameters that name a node are taken from the data, as the ends with most edges, so that every scale
has something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import evaluate, pipeline
from loomgraph.functions import expr as X
from loomgraph.graph import PropertyGraph, dangling, distinct_edges, domain_violations
from loomgraph.operators import community, context, lookup, packages, resolve, score, text, traverse
from loomgraph.schema import BLOCK_TYPES, CALL_TYPES, COMMUNITY_TYPES, CONFIDENCES, DECLARATION_TYPES, EDGE_COLS, EDGE_TYPES, MANIFEST_KEYS, NODE_COLS, NODE_TYPES
from loomgraph.session import Scratch
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


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


N = "n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY built_at DESC, complexity DESC NULLS LAST) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)"
E = "e AS (SELECT id, lower(trim(src)) AS src, lower(trim(dst)) AS dst, lower(trim(type)) AS type, file_path, line, count, confidence FROM edges)"
NE = f"WITH RECURSIVE {N}, {E}"
SRC = "s0 AS (SELECT src AS id FROM e WHERE src IN (SELECT id FROM n) GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
DST = "s0 AS (SELECT dst AS id FROM e WHERE dst IN (SELECT id FROM n) GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
SEEDS = "seeds AS (SELECT id FROM n WHERE qualified_name = (SELECT qualified_name FROM n WHERE id = (SELECT id FROM s0)))"
_PR = "CASE WHEN isnan(pagerank) THEN NULL ELSE pagerank END"


def _g(spark: SparkSession, d: str) -> PropertyGraph:
    return PropertyGraph.from_tables(spark, d)


def _top(g: PropertyGraph, end: str) -> str:
    """Id of the node with most edges at this end; one row comes to the driver."""
    e = g.edges.select(F.col(end).alias("id")).join(g.nodes.select("id"), "id", "left_semi")
    got = e.groupBy("id").count().orderBy(F.desc("count"), "id").limit(1).collect()
    return got[0].id if got else ""


def _qname(g: PropertyGraph, node_id: str) -> str:
    got = lookup.node(g.nodes, node_id).select("qualified_name").collect()
    return got[0][0] if got else ""


# --- build, projections, checks ------------------------------------------------------------------

_NODE_SQL = ", ".join(f"{_PR} AS pagerank" if c == "pagerank" else c for c in NODE_COLS)


@query(f"WITH {N} SELECT {_NODE_SQL} FROM n")
def nodes_latest(spark, d):
    return _g(spark, d).nodes.withColumn("pagerank", F.when(~F.isnan("pagerank"), F.col("pagerank")))


@query(f"WITH {E} SELECT id, src, dst, type, coalesce(file_path, '') AS file_path, coalesce(line, 0) AS line, count, confidence FROM e")
def edges_clean(spark, d):
    return _g(spark, d).edges.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "file_path" else F.coalesce(F.col(c), F.lit(0)).alias(c) if c == "line" else F.col(c) for c in EDGE_COLS])


@query(f"WITH {E} SELECT min(id) AS id, src, dst, type FROM e GROUP BY src, dst, type")
def edges_distinct(spark, d):
    return distinct_edges(_g(spark, d).edges).select("id", "src", "dst", "type")


@query(f"{NE} SELECT id AS edge_id, 'src' AS \"end\", src AS node_id FROM e WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'dst', dst FROM e WHERE dst NOT IN (SELECT id FROM n)")
def validate_dangling(spark, d):
    g = _g(spark, d)
    return dangling(g.edges, g.nodes)


@query(
    f"{NE}, u AS (SELECT 'node' AS kind, id, 'type' AS field, type AS value FROM n WHERE type NOT IN {_in(NODE_TYPES)} UNION ALL SELECT 'node', id, 'confidence', confidence FROM n WHERE confidence NOT IN {_in(CONFIDENCES)}"
    f" UNION ALL SELECT 'edge', CAST(id AS VARCHAR), 'type', type FROM edges WHERE type NOT IN {_in(EDGE_TYPES)} UNION ALL SELECT 'edge', CAST(id AS VARCHAR), 'confidence', confidence FROM e WHERE confidence NOT IN {_in(CONFIDENCES)}) SELECT * FROM u"
)
def validate_domains(spark, d):
    return domain_violations(_g(spark, d).nodes, table(spark, d, "edges"))


@query(f"{NE} SELECT e.* FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def edges_connected(spark, d):
    return _g(spark, d).connected().select(*EDGE_COLS)


@query("SELECT id, substr(sha256(concat_ws('|', qualified_name, language, CAST(start_byte AS VARCHAR))), 1, 16) AS made_id FROM (SELECT DISTINCT id, qualified_name, language, start_byte FROM nodes)")
def make_ids(spark, d):
    n = table(spark, d, "nodes", "id", "qualified_name", "language", "start_byte").distinct()
    return n.select("id", X.make_id("qualified_name", "language", "start_byte").alias("made_id"))


@query(f"WITH {N} SELECT id, CASE WHEN substr(name, 1, 1) BETWEEN 'A' AND 'Z' THEN 'exported' ELSE 'private' END AS visibility FROM n WHERE language = 'go'")
def go_visibility(spark, d):
    return _g(spark, d).nodes.where("language = 'go'").select("id", X.visibility("name").alias("visibility"))


@query(
    f"WITH {N} SELECT id, greatest(0.5, least(3.5, 0.5 + 0.6 * log10(coalesce(usage_score, 0) + 1))) AS scale, greatest(2.0, 3.0 + 1.5 * log10(coalesce(usage_score, 0) + 1)) AS radius,"
    " CASE confidence WHEN 'EXTRACTED' THEN 1.0::DOUBLE WHEN 'INFERRED' THEN 0.7::DOUBLE WHEN 'AMBIGUOUS' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS alpha FROM n"
)
def mesh_encoding(spark, d):
    n = _g(spark, d).nodes.withColumn("usage_score", F.coalesce("usage_score", F.lit(0.0)))
    return n.select("id", X.mesh_scale("usage_score").alias("scale"), X.radius_2d("usage_score").alias("radius"), X.alpha("confidence").alias("alpha"))


# --- lookups -------------------------------------------------------------------------------------

_TOOL_SQL = "id, type, name, qualified_name AS qname, file_path AS file, start_line AS line, confidence, coalesce(signature, '') AS signature, coalesce(usage_score, 0) AS usage_score"


@query(f"{NE}, {SRC} SELECT {_TOOL_SQL} FROM n WHERE id IN (SELECT id FROM s0)")
def node_by_id(spark, d):
    g = _g(spark, d)
    return lookup.tool_shape(lookup.node(g.nodes, _top(g, "src")))


@query(f"WITH {N} SELECT id, qualified_name FROM n WHERE type = 'Package' ORDER BY id LIMIT 50")
def root_packages(spark, d):
    return lookup.roots(_g(spark, d).nodes, 50).select("id", "qualified_name")


@query(f"WITH {E} SELECT * FROM e WHERE type = 'spawns'")
def edges_by_type(spark, d):
    return lookup.edges_by_type(_g(spark, d).edges, "spawns").select(*EDGE_COLS)


_IDS = "ids AS (SELECT id FROM n WHERE type = 'Contract')"


def _ids(g: PropertyGraph) -> DataFrame:
    return g.nodes.where("type = 'Contract'").select("id")


@query(f"{NE}, {_IDS} SELECT e.* FROM e WHERE src IN (SELECT id FROM ids) OR dst IN (SELECT id FROM ids)")
def edges_for_nodes(spark, d):
    g = _g(spark, d)
    return lookup.incident(g.edges, _ids(g)).select(*EDGE_COLS)


@query(f"{NE}, {_IDS} SELECT e.* FROM e WHERE dst IN (SELECT id FROM ids)")
def edges_to_nodes(spark, d):
    g = _g(spark, d)
    return lookup.edges_to(g.edges, _ids(g)).select(*EDGE_COLS)


@query(f"{NE}, {_IDS} SELECT id, type, name, qualified_name FROM n WHERE id IN (SELECT src FROM e WHERE dst IN (SELECT id FROM ids))")
def nodes_by_ids(spark, d):
    g = _g(spark, d)
    return lookup.nodes_by_ids(g.nodes, lookup.edges_to(g.edges, _ids(g)).select(F.col("src").alias("id"))).select("id", "type", "name", "qualified_name")


@query(f"{NE}, {_IDS}, k AS (SELECT id FROM n WHERE id IN (SELECT src FROM e WHERE dst IN (SELECT id FROM ids))) SELECT [src, dst, type] AS edge FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def adjacency_induced(spark, d):
    g = _g(spark, d)
    kept = lookup.nodes_by_ids(g.nodes, lookup.edges_to(g.edges, _ids(g)).select(F.col("src").alias("id")))
    return context.adjacency(kept, g.edges)


@query(f"{NE}, {DST} SELECT {_TOOL_SQL} FROM n WHERE qualified_name = (SELECT qualified_name FROM n WHERE id = (SELECT id FROM s0)) ORDER BY id LIMIT 100")
def find_symbol_exact(spark, d):
    g = _g(spark, d)
    return lookup.tool_shape(lookup.find_symbol(g.nodes, _qname(g, _top(g, "dst"))))


@query(f"{NE}, {DST}, q AS (SELECT name FROM n WHERE id = (SELECT id FROM s0)) SELECT {_TOOL_SQL} FROM n WHERE qualified_name = (SELECT name FROM q) OR ends_with(lower(qualified_name), '.' || lower((SELECT name FROM q))) ORDER BY id LIMIT 100")
def find_symbol_suffix(spark, d):
    g = _g(spark, d)
    name = lookup.node(g.nodes, _top(g, "dst")).select("name").collect()
    return lookup.tool_shape(lookup.find_symbol(g.nodes, name[0][0] if name else "", exact=False))


@query(f"WITH {N} SELECT {_TOOL_SQL} FROM n WHERE contains(lower(name), 'ledger') OR contains(lower(qualified_name), 'ledger') ORDER BY id LIMIT 20")
def search_substring(spark, d):
    return lookup.tool_shape(lookup.search_substring(_g(spark, d).nodes, "ledger"))


@query(f"WITH {N}, p AS (SELECT parent_id FROM pkg_tree WHERE parent_id IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT child_id) DESC, 1 LIMIT 1) SELECT id, type, name FROM n WHERE id IN (SELECT child_id FROM pkg_tree WHERE parent_id = (SELECT parent_id FROM p)) ORDER BY id LIMIT 5000")
def children_of(spark, d):
    t = table(spark, d, "pkg_tree")
    p = t.where("parent_id is not null").groupBy("parent_id").agg(F.countDistinct("child_id").alias("k")).orderBy(F.desc("k"), "parent_id").limit(1).collect()
    return lookup.children_of(_g(spark, d).nodes, t, p[0].parent_id if p else "").select("id", "type", "name")


@query("SELECT coalesce(parent_id, '') AS parent_id, child_id, level, '' AS topic_label FROM pkg_tree")
def hierarchy_pkg(spark, d):
    return lookup.hierarchy("pkg", table(spark, d, "pkg_tree"))


@query("SELECT coalesce(parent_id, '') AS parent_id, child_id, resolution AS level, coalesce(topic_label, '') AS topic_label FROM topic_tree")
def hierarchy_topic(spark, d):
    return lookup.hierarchy("topic", table(spark, d, "topic_tree"))


@query(f"WITH {E} SELECT id, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY id")
def incident_counts(spark, d):
    return lookup.incident_counts(_g(spark, d).edges)


# --- scores and traversals -----------------------------------------------------------------------

_DEG = f"""i AS (SELECT dst AS id, sum(count) AS x, sum(CASE WHEN type IN {_in(CALL_TYPES)} THEN count ELSE 0 END) AS u FROM e GROUP BY dst), o AS (SELECT src AS id, sum(count) AS x FROM e GROUP BY src)"""


@query(f"{NE}, {_DEG} SELECT n.id, CAST(coalesce(i.x, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.x, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.u, 0) AS DOUBLE) AS usage_score FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id)")
def degrees(spark, d):
    g = _g(spark, d)
    return score.degrees(g.nodes, g.edges)


def _pagerank_sql() -> str:
    out = [f"{NE}, ids AS MATERIALIZED (SELECT DISTINCT id FROM n), g AS MATERIALIZED (SELECT src, dst, count(*) AS m FROM e WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids) GROUP BY 1, 2)"]
    out.append("k AS MATERIALIZED (SELECT src, sum(m) AS k FROM g GROUP BY 1), w AS MATERIALIZED (SELECT g.src, dst, m / k AS w FROM g JOIN k USING (src)), c AS MATERIALIZED (SELECT count(*) AS c FROM ids)")
    out.append("r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / c AS pr FROM ids, c)")
    for i in range(score.ITERATIONS):
        out.append(
            f"r{i + 1} AS MATERIALIZED (SELECT ids.id, (1 - 0.85::DOUBLE) / c + 0.85::DOUBLE * (SELECT coalesce(sum(pr), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM k)) / c + 0.85::DOUBLE * coalesce(x, 0) AS pr"
            f" FROM ids LEFT JOIN (SELECT dst AS id, sum(pr * w) AS x FROM w JOIN r{i} ON r{i}.id = w.src GROUP BY dst) USING (id), c)"
        )
    return ", ".join(out) + f" SELECT id, round(pr, 9) AS pagerank FROM r{score.ITERATIONS}"


@query(_pagerank_sql())
def pagerank(spark, d):
    g = _g(spark, d)
    return score.pagerank(g.nodes, g.edges).withColumn("pagerank", F.round("pagerank", 9))


def _bfs_sql(seed: str, depth: int, reverse: bool, types: list[str] | None) -> str:
    near, far = ("dst", "src") if reverse else ("src", "dst")
    t = f" WHERE type IN {_in(types)}" if types else ""
    return f"{NE}, {seed}, {SEEDS}, f AS (SELECT * FROM e{t}), r AS (SELECT id, 0 AS d FROM seeds UNION SELECT f.{far}, r.d + 1 FROM r JOIN f ON f.{near} = r.id WHERE r.d < {depth}), lv AS (SELECT id, min(d) AS depth FROM r GROUP BY id)"


def _bfs_queries(name: str, depth: int, reverse: bool, types: list[str] | None) -> None:
    end, seed = ("dst", DST) if reverse else ("src", SRC)
    near = "dst" if reverse else "src"

    def hood(spark, d):
        g = _g(spark, d)
        return g, traverse.neighborhood(g.nodes, g.edges, _qname(g, _top(g, end)), depth, reverse, types)

    def nodes(spark, d):
        g, h = hood(spark, d)
        return h.ids.join(g.nodes.select("id", "qualified_name"), "id").select("id", "qualified_name", "depth")

    def edges(spark, d):
        _, h = hood(spark, d)
        return h.edges.select("id", "src", "dst", "type")

    base = _bfs_sql(seed, depth, reverse, types)
    QUERIES[f"{name}_d{depth}"], ORACLE[f"{name}_d{depth}"] = nodes, f"{base} SELECT n.id, qualified_name, depth FROM lv JOIN n USING (id)"
    QUERIES[f"{name}_d{depth}_edges"], ORACLE[f"{name}_d{depth}_edges"] = edges, f"{base} SELECT f.id, src, dst, type FROM f JOIN lv ON lv.id = f.{near} WHERE depth < {depth}"
    nodes.__name__, edges.__name__ = f"{name}_d{depth}", f"{name}_d{depth}_edges"


for _d in (1, 2, 3):
    _bfs_queries("neighborhood_fwd", _d, False, None)
_bfs_queries("neighborhood_rev", 2, True, None)
_bfs_queries("callers", 2, True, CALL_TYPES)
_bfs_queries("callees", 2, False, CALL_TYPES)

_R2 = "{0} AS (SELECT id, 0 AS d FROM seeds UNION SELECT e.{2}, {0}.d + 1 FROM {0} JOIN e ON e.{1} = {0}.id WHERE {0}.d < 2)"


@query(f"{NE}, {SRC}, {SEEDS}, {_R2.format('rf', 'src', 'dst')}, {_R2.format('rb', 'dst', 'src')} SELECT id, min(d) AS depth FROM (SELECT * FROM rf UNION ALL SELECT * FROM rb) WHERE id IN (SELECT id FROM n) GROUP BY id")
def subgraph_d2(spark, d):
    g = _g(spark, d)
    h = traverse.subgraph(g.nodes, g.edges, _qname(g, _top(g, "src")), 2)
    return h.ids.join(g.nodes.select("id"), "id", "left_semi").select("id", "depth")


_HOP = f"{NE}, {SRC}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT id, 0 AS d FROM s0 UNION SELECT u.b, r.d + 1 FROM r JOIN u ON u.a = r.id WHERE r.d < 3), h AS (SELECT id, min(d) AS depth FROM r GROUP BY id)"


@query(f"{_HOP} SELECT * FROM h")
def hop_distance_d3(spark, d):
    g = _g(spark, d)
    return traverse.hop_distance(g.edges, g.nodes.where(F.col("id") == _top(g, "src")).select("id"), 3)


@query(f"{_HOP} SELECT h.* FROM h WHERE id IN (SELECT id FROM n) ORDER BY depth, id LIMIT 500")
def visible_set_500(spark, d):
    g = _g(spark, d)
    return traverse.visible_set(g.nodes, g.edges, _top(g, "src"), 3)


@query(f"{_HOP} SELECT id, CASE coalesce(depth, 3) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.92::DOUBLE WHEN 2 THEN 0.55::DOUBLE ELSE 0.18::DOUBLE END AS opacity FROM n LEFT JOIN h USING (id)")
def focus_opacity(spark, d):
    g = _g(spark, d)
    near = traverse.hop_distance(g.edges, g.nodes.where(F.col("id") == _top(g, "src")).select("id"), 3)
    return g.nodes.select("id").join(near, "id", "left").select("id", X.focus_opacity("depth").alias("opacity"))


# --- package tree --------------------------------------------------------------------------------

_PKG = """pk AS (SELECT qualified_name AS q, max(id) AS pid FROM n WHERE type = 'Package' GROUP BY 1),
fl AS (SELECT id, file_path, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE file_path END AS dir FROM n WHERE type = 'File'),
fp AS (SELECT fl.id AS file_id, arg_max(pid, length(q)) AS package_id, arg_max(q, length(q)) AS package FROM fl JOIN pk ON dir = q OR starts_with(dir, q || '/') GROUP BY fl.id)"""


@query(f"WITH {N}, {_PKG} SELECT * FROM fp")
def package_of_file(spark, d):
    return packages.package_of_file(_g(spark, d).nodes)


@query(
    f"""WITH {N}, {_PKG},
lv AS (SELECT fi.file_path, fi.file_id, coalesce(length(package) - length(replace(package, '/', '')) + 1, 2) AS level FROM (SELECT file_path, max(id) AS file_id FROM n WHERE type = 'File' GROUP BY 1) fi LEFT JOIN fp USING (file_id)),
ca AS (SELECT q, call_id, coalesce(level, 2) + 1 AS level FROM (SELECT qualified_name AS q, max(id) AS call_id, arg_max(file_path, id) AS file_path FROM n WHERE type IN ('Function', 'Method') GROUP BY 1) LEFT JOIN lv USING (file_path))
SELECT package_id AS parent_id, file_id AS child_id, length(package) - length(replace(package, '/', '')) + 1 AS level FROM fp
UNION SELECT lv.file_id, n.id, lv.level + 1 FROM n JOIN lv USING (file_path) WHERE type IN {_in(DECLARATION_TYPES)}
UNION SELECT call_id, n.id, ca.level + 1 FROM n JOIN ca ON ca.q = split_part(n.qualified_name, '#', 1) WHERE type IN {_in(BLOCK_TYPES)} AND contains(n.qualified_name, '#')"""
)
def package_tree(spark, d):
    return packages.package_tree(_g(spark, d).nodes)


@query(f"WITH {N} SELECT id, length(qualified_name) - length(replace(qualified_name, '/', '')) AS depth FROM n WHERE type = 'Package'")
def package_depth(spark, d):
    return _g(spark, d).nodes.where("type = 'Package'").select("id", X.depth_of("qualified_name").alias("depth"))


# --- text ----------------------------------------------------------------------------------------

_TOK = f"regexp_extract_all(translate(lower(coalesce(txt, '')), '{X._MARKED}', '{X._PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"
_POST = (
    f"f AS (SELECT id, 'name' AS col, name AS txt FROM n UNION ALL SELECT id, 'qualified_name', qualified_name FROM n UNION ALL SELECT id, 'signature', signature FROM n UNION ALL SELECT id, 'doc_comment', doc_comment FROM n),"
    f" l AS (SELECT id, col, {_TOK} AS ts FROM f), p AS (SELECT unnest(ts) AS token, id, col, CAST(unnest(range(len(ts))) AS INTEGER) AS pos FROM l)"
)


def _index(g: PropertyGraph) -> DataFrame:
    return text.postings(g.nodes, "id", text.NODE_FIELDS)


@query(f"WITH {N}, {_POST} SELECT * FROM p")
def postings(spark, d):
    return _index(_g(spark, d))


@query(f"WITH x AS (SELECT doc_id, text AS txt FROM documents), l AS (SELECT doc_id, {_TOK} AS ts FROM x) SELECT doc_id, CAST(len(ts) AS BIGINT) AS n_tokens, CAST(len(list_distinct(ts)) AS BIGINT) AS n_distinct FROM l")
def tokenize_docs(spark, d):
    t = table(spark, d, "documents", "doc_id", "text").select("doc_id", X.tokens("text").alias("ts"))
    return t.select("doc_id", F.size("ts").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("bigint").alias("n_distinct"))


@query(f"WITH {N}, {_POST} SELECT DISTINCT id FROM p WHERE starts_with(token, 'gene')")
def search_prefix(spark, d):
    return text.match(_index(_g(spark, d)), text.rewrite("gene"))


@query(f"WITH {N}, {_POST} SELECT DISTINCT id FROM p WHERE token = 'how' OR starts_with(token, 'does') OR starts_with(token, 'ledger') OR starts_with(token, 'work')")
def search_or(spark, d):
    return text.match(_index(_g(spark, d)), text.rewrite("how does ledger work"))


@query(f"WITH {N}, {_POST} SELECT id FROM p WHERE token = 'lock' OR token = 'whole' GROUP BY id HAVING count(DISTINCT token) = 2")
def search_and(spark, d):
    return text.match(_index(_g(spark, d)), text.Query("all", (("lock", False), ("whole", False))))


@query(f"WITH {N}, {_POST} SELECT DISTINCT a.id FROM p a JOIN p b ON a.id = b.id AND a.col = b.col AND b.pos = a.pos + 1 JOIN p c ON a.id = c.id AND a.col = c.col AND c.pos = a.pos + 2 WHERE a.token = 'its' AND b.token = 'whole' AND c.token = 'run'")
def search_phrase(spark, d):
    return text.match(_index(_g(spark, d)), text.rewrite('"its whole run"'))


_BM = """dl AS (SELECT id, count(*) AS dl FROM p GROUP BY id), co AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
tf AS (SELECT id, token, count(*) AS tf FROM p WHERE token IN ('ledger', 'lock', 'retries') GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score FROM tf JOIN df USING (token) JOIN dl USING (id), co GROUP BY id)"""


@query(f"WITH {N}, {_POST}, {_BM} SELECT id, round(score, 6) AS score FROM bm")
def search_bm25(spark, d):
    return text.bm25(_index(_g(spark, d)), ["ledger", "lock", "retries"]).withColumn("score", F.round("score", 6))


_SEARCH = f"""{_POST}, m AS (SELECT DISTINCT id FROM p WHERE starts_with(token, 'ledger') OR starts_with(token, 'lock') OR starts_with(token, 'retries')), {_BM},
cand AS (SELECT id, row_number() OVER (ORDER BY coalesce(score, 0) DESC, id) AS rank FROM m LEFT JOIN bm USING (id) ORDER BY rank LIMIT 30)"""
_TASK = "ledger lock retries"


@query(f"WITH {N}, {_SEARCH} SELECT id, rank FROM cand")
def search_ranked(spark, d):
    g = _g(spark, d)
    return text.search(g.nodes, _index(g), _TASK, 30).select("id", "rank")


@query(f"WITH {N} SELECT id, CAST((octet_length(encode(coalesce(doc_comment, ''))) + 3) // 4 AS BIGINT) AS tokens FROM n")
def token_estimate(spark, d):
    return _g(spark, d).nodes.select("id", X.estimate_tokens("doc_comment").alias("tokens"))


_CTX = f"""{_SEARCH}, {E}, ex AS (SELECT id FROM cand UNION SELECT src FROM e WHERE src IN (SELECT id FROM cand) OR dst IN (SELECT id FROM cand) UNION SELECT dst FROM e WHERE src IN (SELECT id FROM cand) OR dst IN (SELECT id FROM cand)),
nx AS (SELECT n.*, coalesce({_PR}, 0) AS pr, coalesce(usage_score, 0) AS us FROM n WHERE id IN (SELECT id FROM ex)), mx AS (SELECT greatest(1e-9, max(pr)) AS p, greatest(1e-9, max(us)) AS u FROM nx),
best AS (SELECT nx.*, round(0.5 * coalesce(1.0::DOUBLE / rank, 0) + 0.3 * pr / p + 0.2 * us / u, 9) AS score FROM nx LEFT JOIN cand USING (id), mx ORDER BY score DESC, id LIMIT 30)"""


def _best(spark, d):
    g = _g(spark, d)
    index = Scratch(spark, "postings").save(_index(g))  # as a persisted graph has it
    cand = context.pinned(text.search(g.nodes, index, _TASK, context.CANDIDATES))
    return g, context.fuse(g.nodes, context.expand(cand, g.edges), cand)


@query(f"WITH {N}, {_CTX} SELECT id, name, type, qualified_name AS qname, round(score, 6) AS score FROM best")
def context_topk(spark, d):
    return lookup.node_ref(_best(spark, d)[1].withColumn("score", F.round("score", 6)))


def _contents(spark, d) -> DataFrame:
    """One row per path: content as bytes.  A file that comes again has equal content."""
    return table(spark, d, "source_files", "file_path", "content").dropDuplicates(["file_path"]).select("file_path", F.encode("content", "UTF-8").alias("content"))


_BLOB = "sf AS (SELECT file_path, any_value(content) AS content FROM source_files GROUP BY 1), bl AS (SELECT id, start_byte, end_byte, content FROM n JOIN sf USING (file_path) WHERE type <> 'Package' AND start_byte >= 0 AND end_byte > start_byte AND end_byte <= octet_length(encode(content)))"


@query(f"WITH {N}, {_BLOB} SELECT id AS node_id, CAST(end_byte - start_byte AS INTEGER) AS n_bytes FROM bl")
def blob_slice(spark, d):
    return tree.blobs(_g(spark, d).nodes, _contents(spark, d)).select("node_id", F.octet_length("source").alias("n_bytes"))


@query(
    f"""WITH RECURSIVE {N}, {_CTX}, {_BLOB},
o AS (SELECT row_number() OVER (ORDER BY best.score DESC, best.id) - 1 AS i, best.id, (bl.end_byte - bl.start_byte + 3) // 4 AS body, (octet_length(encode(coalesce(signature, '') || ' ' || coalesce(doc_comment, ''))) + 3) // 4 AS summ FROM best LEFT JOIN bl ON bl.id = best.id),
st AS (SELECT 0 AS i, CAST((19 + 3) // 4 AS BIGINT) AS tokens, false AS over, CAST([] AS VARCHAR[]) AS b, CAST([] AS VARCHAR[]) AS s
UNION ALL SELECT st.i + 1,
 CASE WHEN st.over THEN st.tokens WHEN o.i < 5 AND body IS NOT NULL THEN CASE WHEN tokens + body <= 8000 THEN tokens + body ELSE tokens END WHEN len(s) < 15 AND tokens + summ <= 8000 THEN tokens + summ ELSE tokens END,
 st.over OR (o.i < 5 AND body IS NOT NULL AND tokens + body > 8000),
 CASE WHEN NOT st.over AND o.i < 5 AND body IS NOT NULL AND tokens + body <= 8000 THEN list_append(b, o.id) ELSE b END,
 CASE WHEN NOT st.over AND NOT (o.i < 5 AND body IS NOT NULL) AND len(s) < 15 AND tokens + summ <= 8000 THEN list_append(s, o.id) ELSE s END
FROM st JOIN o ON o.i = st.i)
SELECT b AS bodies, s AS summaries, tokens, tokens >= 8000 AS trimmed FROM st ORDER BY i DESC LIMIT 1"""
)
def context_pack(spark, d):
    g, best = _best(spark, d)
    kept = best.select("id").collect()  # at most 30 rows
    near = g.nodes.where(F.col("id").isin([r.id for r in kept]))
    files = _contents(spark, d).join(near.select("file_path").distinct(), "file_path", "left_semi")
    return context.pack(best, tree.blobs(near, files), _TASK)


# --- resolution ----------------------------------------------------------------------------------

# references are made from the edges' targets: name of the target as a caller would write it
_PEND = "pend AS (SELECT e.id AS ref_id, e.src AS src_id, e.type AS edge_type, split_part(t.qualified_name, '.', -1) AS target, t.name AS target_name, e.line FROM e JOIN n t ON t.id = e.dst WHERE e.type IN ('calls', 'has_modifier'))"


def _pending(g: PropertyGraph, edge_type: str, by: str) -> DataFrame:
    t = g.nodes.select(F.col("id").alias("dst"), X.simple_name("qualified_name").alias("simple"), "name")
    e = g.edges.where(F.col("type") == edge_type).select("id", F.col("src").alias("src_id"), F.col("type").alias("edge_type"), "dst", "line")
    return e.join(t, "dst").select("src_id", "edge_type", F.col(by).alias("target_qname"), "line")


def _ordered(g: PropertyGraph, language: str) -> DataFrame:
    return g.nodes.where(F.col("language") == language).withColumn("file_ord", F.col("file_path")).withColumn("ord", F.col("start_byte"))


@query(
    f"""{NE}, {_PEND}, df AS (SELECT id, file_path, start_byte, unnest(list_distinct([qualified_name, split_part(qualified_name, '.', -1)])) AS k FROM n WHERE language = 'go' AND type IN ('Function', 'Method')),
ix AS (SELECT k, arg_max(id, (file_path, start_byte, id)) AS dst FROM df GROUP BY k) SELECT src_id AS src, dst, edge_type AS type, line, 1 AS count, 'EXTRACTED' AS confidence FROM pend JOIN ix ON k = target WHERE edge_type = 'calls'"""
)
def resolve_last_wins(spark, d):
    g = _g(spark, d)
    return resolve.resolve_go(_pending(g, "calls", "simple"), _ordered(g, "go"))


@query(f"{NE}, {_PEND}, ix AS (SELECT name AS k, arg_min(id, (file_path, start_byte, id)) AS dst FROM n WHERE language = 'ts' AND type IN ('Function', 'Method', 'Class') GROUP BY 1) SELECT src_id AS src, dst, edge_type AS type, line, 1 AS count, 'INFERRED' AS confidence FROM pend JOIN ix ON k = target_name WHERE edge_type = 'calls'")
def resolve_first_wins(spark, d):
    g = _g(spark, d)
    return resolve.resolve_ts(_pending(g, "calls", "name"), _ordered(g, "ts"))


@query(
    f"""{NE}, {_PEND}, sn AS (SELECT * FROM n WHERE language = 'sol'), ix AS (SELECT name AS k, arg_min(id, (file_path, start_byte, id)) AS dst, arg_min(file_path, (file_path, start_byte, id)) AS df FROM sn WHERE type = 'Modifier' GROUP BY 1)
SELECT src_id AS src, dst, edge_type AS type, line, 1 AS count, CASE WHEN sn.file_path IS NOT DISTINCT FROM df THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence FROM pend JOIN ix ON k = target_name LEFT JOIN sn ON sn.id = src_id WHERE edge_type = 'has_modifier'"""
)
def resolve_modifiers(spark, d):
    g = _g(spark, d)
    return resolve.resolve_sol(_pending(g, "has_modifier", "name"), _ordered(g, "sol"))


@query(
    f"""{NE}, {_PEND}, st AS (SELECT id AS src_id, file_path, split_part(qualified_name, '#', 1) AS q FROM n WHERE type = 'CallSite'), fn AS (SELECT file_path, qualified_name AS q, arg_max(id, (start_byte, id)) AS parent FROM n WHERE type IN ('Function', 'Method') GROUP BY 1, 2),
lf AS (SELECT src_id, parent FROM st JOIN fn USING (file_path, q)) SELECT coalesce(parent, src_id) AS src_id, edge_type, target AS target_qname, line FROM pend LEFT JOIN lf USING (src_id) WHERE edge_type = 'calls'"""
)
def callsite_lift(spark, d):
    g = _g(spark, d)
    return resolve.lift_callsites(_pending(g, "calls", "simple"), g.nodes.withColumn("ord", F.col("start_byte")))


# --- communities ---------------------------------------------------------------------------------

_CP = f"cp AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS w FROM e WHERE type IN {_in(COMMUNITY_TYPES)} AND src <> dst GROUP BY 1, 2)"
_CD = "cd AS (SELECT id, CAST(sum(w) AS BIGINT) AS k FROM (SELECT a AS id, w FROM cp UNION ALL SELECT b, w FROM cp) GROUP BY id)"
_CM = "cm AS (SELECT id, split_part(file_path, '/', 1) AS comm FROM n)"


def _members(g: PropertyGraph) -> DataFrame:
    """A fixed partition for the aggregates: the repository."""
    return g.nodes.select("id", F.substring_index("file_path", "/", 1).alias("comm"), "name", "qualified_name", "pagerank")


@query(f"WITH {E}, {_CP} SELECT * FROM cp")
def community_edges(spark, d):
    return community.community_edges(_g(spark, d).edges)


@query(f"WITH {E}, {_CP}, {_CD} SELECT * FROM cd")
def community_degrees(spark, d):
    return community.weighted_degrees(community.community_edges(_g(spark, d).edges))


@query(f"{NE}, {_CP}, {_CD}, {_CM} SELECT comm, CAST(sum(coalesce(k, 0)) AS BIGINT) AS weight FROM cm LEFT JOIN cd USING (id) GROUP BY comm")
def community_weight(spark, d):
    g = _g(spark, d)
    return community.community_weights(community.weighted_degrees(community.community_edges(g.edges)), _members(g).select("id", "comm"))


@query(f"{NE}, {_CP}, {_CM} SELECT x.id, comm, CAST(sum(w) AS BIGINT) AS w FROM (SELECT a AS id, b, w FROM cp UNION ALL SELECT b, a, w FROM cp) x JOIN cm ON cm.id = x.b GROUP BY 1, 2")
def community_neighbours(spark, d):
    g = _g(spark, d)
    return community.neighbour_weights(community.community_edges(g.edges), _members(g).select("id", "comm"))


@query(f"{NE}, {_CP}, {_CM} SELECT least(m.comm, k.comm) AS a, greatest(m.comm, k.comm) AS b, CAST(sum(w) AS BIGINT) AS w FROM cp JOIN cm m ON m.id = cp.a JOIN cm k ON k.id = cp.b GROUP BY 1, 2")
def community_supergraph(spark, d):
    g = _g(spark, d)
    return community.supergraph(community.community_edges(g.edges), _members(g).select("id", "comm"))


_DP = "dp AS (SELECT comm, pk, c FROM (SELECT comm, pk, c, row_number() OVER (PARTITION BY comm ORDER BY c DESC, pk) AS rn FROM (SELECT comm, regexp_extract(qualified_name, '^(.+)\\.[^.]*$', 1) AS pk, count(*) AS c FROM n JOIN cm USING (id) WHERE regexp_extract(qualified_name, '^(.+)\\.[^.]*$', 1) <> '' GROUP BY 1, 2)) WHERE rn = 1)"


@query(f"WITH {N}, {_CM}, {_DP} SELECT comm, pk AS package, c AS n FROM dp")
def dominant_package(spark, d):
    return community.dominant_package(_members(_g(spark, d)))


@query(f"WITH {N}, {_CM} SELECT comm, arg_min(name, (-coalesce({_PR}, 0), id)) AS top FROM n JOIN cm USING (id) GROUP BY comm")
def top_member(spark, d):
    return community.top_member(_members(_g(spark, d)))


@query(
    f"""WITH {N}, {_CM}, t3 AS (SELECT comm, list(name ORDER BY name, id) AS ns FROM (SELECT comm, name, id, row_number() OVER (PARTITION BY comm ORDER BY name, id) AS rn FROM n JOIN cm USING (id)) WHERE rn <= 3 GROUP BY comm HAVING count(*) = 3),
px AS (SELECT comm, list_reduce(list_prepend('', list_transform(range(1, CAST(least(length(ns[1]), length(ns[2]), length(ns[3])) AS BIGINT) + 1), lambda i: CASE WHEN substr(ns[1], 1, i) = substr(ns[2], 1, i) AND substr(ns[1], 1, i) = substr(ns[3], 1, i) THEN substr(ns[1], 1, i) ELSE '' END)), lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) AS prefix FROM t3)
SELECT comm, prefix FROM px WHERE octet_length(encode(prefix)) >= 3"""
)
def common_prefix(spark, d):
    return community.name_prefix(_members(_g(spark, d)))


@query()
def communities(spark, d):
    # of the nodes only ids are asked for, so no row has to be picked
    return community.communities(table(spark, d, "nodes").where("id IS NOT NULL"), _g(spark, d).edges)


# --- sources, manifest, export -------------------------------------------------------------------


@query("SELECT DISTINCT file_path, CASE lower(regexp_extract(file_path, '\\.[^./]*$')) WHEN '.go' THEN 'go' WHEN '.sol' THEN 'sol' ELSE 'ts' END AS language FROM source_files")
def classify_extension(spark, d):
    return tree.source_files(table(spark, d, "source_files", "file_path").distinct()).select("file_path", "language")


@query("SELECT file_path, row_number() OVER (ORDER BY string_split(file_path, '/')) AS ord FROM (SELECT DISTINCT file_path FROM source_files)")
def walk_order(spark, d):
    files = table(spark, d, "source_files", "file_path").distinct().withColumn("parts", tree.walk_order())
    return store.chunks(files, "parts", 1).select("file_path", (F.col("chunk") + 1).alias("ord"))


@query("SELECT DISTINCT file_path FROM source_files WHERE starts_with(file_path, 'meridian-ledger/') OR regexp_matches(split_part(file_path, '/', -1), '^[^/]*\\.generated\\.[^/]*$') OR regexp_matches(split_part(file_path, '/', -1), '^[^/]*_test\\.go$')")
def ignore_match(spark, d):
    files = table(spark, d, "source_files", "file_path").distinct()
    return files.where(tree.ignored(F.col("file_path"), tree.parse_ignore("# local\n\nmeridian-ledger/\n*.generated.*\n*_test.go\n")))


@query(
    "SELECT repo, "
    + ", ".join(
        f"max(value) FILTER (key = '{k}') AS {k}" if k not in store.MANIFEST_JSON else f"try_cast(max(value) FILTER (key = '{k}') AS BIGINT) AS {k}"
        for k in MANIFEST_KEYS
        if store.MANIFEST_JSON.get(k, "bigint") == "bigint"
    )
    + " FROM manifest GROUP BY repo"
)
def manifest_typed(spark, d):
    m = store.read_manifest(table(spark, d, "manifest"))
    return m.select("repo", *[k for k in MANIFEST_KEYS if store.MANIFEST_JSON.get(k, "bigint") == "bigint"])


@query("SELECT repo, CAST(max(value) FILTER (key = 'stats') ->> '$.nodes' AS BIGINT) AS n_nodes, CAST(max(value) FILTER (key = 'languages') ->> '$.go' AS INTEGER) AS n_go FROM manifest GROUP BY repo")
def manifest_stats(spark, d):
    m = store.read_manifest(table(spark, d, "manifest"))
    return m.select("repo", F.col("stats")["nodes"].alias("n_nodes"), F.col("languages")["go"].alias("n_go"))


@query("SELECT repo, coalesce(max(value) FILTER (key = 'staleness_method') = 'git' AND coalesce(max(value) FILTER (key = 'src_commit'), '') <> 'ff94cad9e8092706ecc98d8901897c63448d3205', false) AS graph_stale FROM manifest GROUP BY repo")
def graph_stale(spark, d):
    m = store.staleness(store.read_manifest(table(spark, d, "manifest")), "ff94cad9e8092706ecc98d8901897c63448d3205")
    return m.select("repo", "graph_stale")


@query(f"WITH {N} SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 5000) AS INTEGER) AS chunk FROM n")
def node_chunks(spark, d):
    return store.chunks(_g(spark, d).nodes.select("id"), "id", store.NODE_CHUNK)


@query(f"WITH {N} SELECT language, count(*) AS n_nodes, count(DISTINCT file_path) AS n_files FROM n GROUP BY language")
def build_stats(spark, d):
    return _g(spark, d).nodes.groupBy("language").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("file_path").alias("n_files"))


def _parsed(spark, d) -> DataFrame:
    return pipeline.parse_files(table(spark, d, "source_files", "file_path", "content").dropDuplicates(["file_path"]))


@query()
def parse_nodes(spark, d):
    """Nodes of all source files by kind and language."""
    n = _parsed(spark, d).select(F.inline("nodes"))
    return n.groupBy("language", "type").agg(F.count(F.lit(1)).alias("n"))


@query()
def parse_errors(spark, d):
    return _parsed(spark, d).where("error is not null").select("file_path", "language", "error")


@query()
def parse_resolved(spark, d):
    """Edges of all source files after resolution, by type."""
    g, _ = pipeline.resolve_parsed(_parsed(spark, d))
    return g.edges.groupBy("type", "confidence").agg(F.count(F.lit(1)).alias("n"))


# --- evaluation ----------------------------------------------------------------------------------

_SYM = "list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[ ,\\n\"`]+'), lambda w: contains(w, '.') AND NOT starts_with(w, '.') AND NOT ends_with(w, '.')), lambda w: trim(w, '.:;()'))"


@query(f"SELECT doc_id, {_SYM} AS symbols FROM documents")
def extract_symbols(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", X.extract_symbols("text").alias("symbols"))


_WANT = "['net.HashLeaf', 'auth.CheckVault', 'index.BuildVoucher', 'api.SyncPacket']"


@query(
    f"WITH s AS (SELECT doc_id, list_distinct({_SYM}) AS g, {_WANT} AS w FROM documents) SELECT doc_id, CASE WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, w)) / len(g) END AS precision_, len(list_intersect(g, w)) / 4 AS recall_ FROM s"
)
def precision_recall(spark, d):
    want = F.array(*[F.lit(x) for x in ("net.HashLeaf", "auth.CheckVault", "index.BuildVoucher", "api.SyncPacket")])
    s = table(spark, d, "documents", "doc_id", "text").select("doc_id", X.extract_symbols("text").alias("g"))
    return s.select("doc_id", X.precision(F.col("g"), want).alias("precision_"), X.recall(F.col("g"), want).alias("recall_"))


@query("SELECT doc_id, (contains(t, 'keeps')::INT + contains(t, 'parser')::INT + contains(t, 'files')::INT) >= 0.6 * 3 AS met FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def rubric_check(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", X.rubric_hit(F.col("text"), F.lit("keeps the parser files")).alias("met"))


_RES = "r AS (SELECT CASE kind WHEN 'ticket' THEN 'alpha' WHEN 'design' THEN 'beta' WHEN 'howto' THEN 'gamma' WHEN 'review' THEN 'delta' ELSE kind END AS baseline, coalesce(n_chars, 0) AS input_tokens, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.5 END AS score FROM documents)"


@query(f"WITH {_RES} SELECT baseline, count(*) AS n, round(avg(input_tokens), 6) AS avg_input_tokens, round(avg(score), 6) AS avg_score FROM r GROUP BY baseline")
def eval_report(spark, d):
    b = F.when(F.col("kind") == "ticket", "alpha").when(F.col("kind") == "design", "beta").when(F.col("kind") == "howto", "gamma").when(F.col("kind") == "review", "delta").otherwise(F.col("kind"))
    r = table(spark, d, "documents", "kind", "n_chars", "lang").select(b.alias("baseline"), F.coalesce("n_chars", F.lit(0)).alias("input_tokens"), F.when(F.col("lang") == "en", 1.0).otherwise(0.5).alias("score"))
    return evaluate.summary(r).select("baseline", "n", F.round("avg_input_tokens", 6).alias("avg_input_tokens"), F.round("avg_score", 6).alias("avg_score"))
