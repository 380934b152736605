"""The reference's operators as queries over the test tables, and the DuckDB SQL that gives the same rows.

The tables stand for the operators' inputs: parts are nodes, consecutive lines of an order are edges, orders are
commits of brands, events are pattern instances, years of orders are snapshots.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlattice.functions import classify, scalars
from driftlattice.functions import fingerprint as P
from driftlattice.functions.paths import node_id_problem
from driftlattice.operators import boundaries as B
from driftlattice.operators import community as L
from driftlattice.operators import coupling, divergence, graph, patterns
from driftlattice.operators.resolve import dependency_edges, resolve_imports
from driftlattice.sources import adapters, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- base relations -------------------------------------------------------------------------------------------------

NODE = "p_brand || '/' || p_type || '/' || p_partkey"
NODES_SQL = f"SELECT p_partkey, {NODE} AS id, p_size FROM part"
LINES_SQL = "SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey"
GRAPH_SQL = f"nodes AS ({NODES_SQL}), lines AS ({LINES_SQL}), edges AS (SELECT x.id AS source, y.id AS target FROM lines JOIN nodes x ON s = x.p_partkey JOIN nodes y ON t = y.p_partkey)"


def nodes_of(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", "p_partkey").alias("id"), "p_size")


def edges_of(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = li.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("s"))
    b = li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("t"))
    lines = a.join(b, ["o", "n"]).filter("s != t").select("s", "t").distinct()
    n = nodes_of(spark, d)
    x, y = n.select(F.col("p_partkey").alias("s"), F.col("id").alias("source")), n.select(F.col("p_partkey").alias("t"), F.col("id").alias("target"))
    return lines.join(x, "s").join(y, "t").select("source", "target")


def instances_of(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("props").alias("fingerprint"))


COUNTS_SQL = "c AS (SELECT event_type AS category, props AS fingerprint, count(*) AS n FROM events GROUP BY ALL)"
METRICS_SQL = COUNTS_SQL + ", m AS (SELECT category, sum(n)::BIGINT AS total, count(*)::BIGINT AS n_distinct, CASE WHEN count(*) <= 1 THEN 0 ELSE greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) END AS h, count(*) / sum(n)::DOUBLE AS drift FROM c GROUP BY category)"


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# --- patterns -------------------------------------------------------------------------------------------------------


@query(f"WITH {METRICS_SQL} SELECT category, total, n_distinct, round(h, 6) AS entropy, round(drift, 6) AS convention_drift FROM m")
def pattern_metrics(spark, d):
    return rounded(patterns.pattern_metrics(instances_of(spark, d)), "entropy", "convention_drift")


@query(f"WITH {METRICS_SQL} SELECT category, total, n_distinct, round(CASE WHEN n_distinct <= 1 THEN 0 ELSE least(greatest(h / log2(n_distinct), 0), 1) END, 6) AS entropy, round(drift, 6) AS convention_drift FROM m")
def pattern_metrics_from_catalog(spark, d):
    return rounded(patterns.catalog_metrics(patterns.pattern_counts(instances_of(spark, d))), "entropy", "convention_drift")


@query(f"WITH {METRICS_SQL} SELECT round(coalesce(sum(h), 0), 6) AS total_entropy, round(coalesce(avg(drift), 0), 6) AS convention_drift FROM m")
def pattern_metrics_total(spark, d):
    return rounded(patterns.totals(patterns.pattern_metrics(instances_of(spark, d))), "total_entropy", "convention_drift")


@query("SELECT event_type AS category, props AS fingerprint, count(*)::BIGINT AS count FROM events GROUP BY ALL HAVING count(*) >= 15")
def pattern_catalog_min_count(spark, d):
    return patterns.at_least(patterns.pattern_counts(instances_of(spark, d)), 15)


HINTS = [
    ("call_expression", "promise.then(resolve)", "typescript"), ("call_expression", "fetch(url).catch(err => {})", "javascript"), ("call_expression", "describe('suite', fn)", "typescript"),
    ("call", "json.dumps(o)", "python"), ("call_expression", "json.Marshal(v)", "go"), ("call_expression", "JSON.parse(s)", "typescript"), ("call_expression", "useState(0)", "typescript"),
    ("call_expression", "useEffect(fn, [])", "typescript"), ("call_expression", "logger.get(\"x\")", "typescript"), ("call_expression", "console.log(\"x\")", "typescript"), ("call_expression", "log.debug(\"x\")", "javascript"),
    ("call", "logging.info(\"x\")", "python"), ("call", "print(x)", "python"), ("call_expression", "fmt.Println(\"x\")", "go"), ("call_expression", "System.out.println(\"x\")", "java"),
    ("call_expression", "createSlice({})", "typescript"), ("call_expression", "createStore(rootReducer)", "javascript"), ("call_expression", "create((set) => ({}))", "typescript"), ("call_expression", "useSelector(s => s.user)", "typescript"),
    ("call_expression", "prisma.user.create(data)", "typescript"), ("call_expression", "z.object({})", "typescript"), ("call_expression", "UserSchema.safeParse(input)", "typescript"), ("call", "Field(default=0)", "python"),
    ("call_expression", "SomeClass.parse(x)", "typescript"), ("call_expression", "fetch(\"/api/users\")", "typescript"), ("call_expression", "axios.get(\"/api\")", "typescript"), ("call_expression", "db.query(sql)", "go"),
    ("call", "cursor.execute(sql)", "python"), ("call", "requests.get(url)", "python"), ("call_expression", "app.get('/u', h)", "typescript"), ("call_expression", "r.GET(\"/users\", h)", "go"),
    ("call_expression", "xs.map(f)", "typescript"), ("call_expression", "items.forEach(cb)", "javascript"), ("call_expression", "client.read(buf)", "typescript"), ("call_expression", "Promise.all([a, b])", "typescript"),
    ("call", "asyncio.gather(*tasks)", "python"), ("call_expression", "Math.max(a, b)", "typescript"), ("call", "len(x)", "python"), ("call_expression", "os.Exit(1)", "go"),
    ("macro_invocation", "tracing::info!(\"hi\")", "rust"), ("macro_invocation", "vec![1, 2, 3]", "rust"), ("macro_invocation", "println!(\"x\")", "rust"), ("try_expression", "f()?", "rust"), ("await_expression", "await x", "typescript"),
    ("class_definition", "class A:", "python"), ("list_comprehension", "[x for x in y]", "python"), ("go_statement", "go f()", "go"), ("decorator", "@Injectable()", "typescript"), ("optional_chain", "a?.b", "typescript"),
    ("with_statement", "with f:", "python"), ("closure_expression", "|x| x", "rust"), ("as_expression", "x as T", "typescript"), ("lambda", "lambda: 0", "python"), ("arrow_function", "() => 0", "typescript"), ("await", "await x", "python"),
]
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
HINTS_SQL = "h(node_kind, text, language) AS (VALUES " + ", ".join(f"({', '.join(map(_quoted, h))})" for h in HINTS) + ")"
KINDS_CASE = " ".join(f"WHEN node_kind IN ({', '.join(map(_quoted, ks))}) THEN '{c}'" for c, ks in classify.NODE_KINDS.items())
CALLS_CASE = " ".join(f"WHEN language IN ({', '.join(map(_quoted, ls))}) AND regexp_matches(text, {_quoted(p)}) THEN '{c}'" for c, ls, p in classify.CALLS)
CLASSIFY_SQL = f"WITH {HINTS_SQL} SELECT node_kind, text, language, CASE WHEN node_kind IN ('call', 'call_expression') THEN CASE {CALLS_CASE} END WHEN node_kind = 'macro_invocation' THEN CASE WHEN language = 'rust' AND regexp_matches(text, {_quoted(classify.RUST_LOGGING)}) THEN 'logging' ELSE 'resource_management' END ELSE CASE {KINDS_CASE} END END AS category FROM h"


def hints_of(spark) -> DataFrame:
    return spark.createDataFrame(HINTS, "node_kind string, text string, language string")


@query(CLASSIFY_SQL)
def classify_hints(spark, d):
    return hints_of(spark).withColumn("category", classify.hint_category(F.col("node_kind"), F.col("text"), F.col("language")))


@query(f"WITH {HINTS_SQL} SELECT DISTINCT node_kind, CASE {KINDS_CASE} END AS category FROM h")
def classify_node_kinds(spark, d):
    return hints_of(spark).select("node_kind").distinct().withColumn("category", classify.node_kind_category(F.col("node_kind")))


@query("WITH x AS (" + CLASSIFY_SQL + ") SELECT category, count(*)::BIGINT AS n FROM x WHERE category IS NOT NULL GROUP BY category")
def category_counts(spark, d):
    return classify_hints(spark, d).filter("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name FROM (VALUES " + ", ".join(f"('{c}')" for c in classify.CATEGORIES) + ") AS v(name)")
def list_categories(spark, d):
    return classify.categories(spark).select("name")


@query()
def fingerprints(spark, d):
    return P.with_fingerprints(hints_of(spark).select("node_kind").distinct())


@query()
def normalize_hash(spark, d):
    trees = table(spark, d, "part").select("p_brand", "p_type").distinct()
    tree = F.to_json(F.struct(F.col("p_brand").alias("kind"), F.array(F.struct(F.col("p_type").alias("kind"))).alias("children")))
    return trees.withColumn("fingerprint", P.tree_fingerprints(tree))


EVENT_CATALOG_SQL = "SELECT event_type AS category, props AS fingerprint, count(*)::BIGINT AS count, string_agg(user_id || ':' || event_id, ',' ORDER BY user_id, event_id) AS locations FROM events {where} GROUP BY ALL HAVING count(*) >= 5"


def _event_catalog(df: DataFrame) -> DataFrame:
    spots = F.sort_array(F.collect_list(F.struct("user_id", "event_id")))
    listed = F.array_join(F.transform(spots, lambda x: F.concat_ws(":", x["user_id"], x["event_id"])), ",")
    return patterns.at_least(df.groupBy(F.col("event_type").alias("category"), F.col("props").alias("fingerprint")).agg(F.count(F.lit(1)).alias("count"), listed.alias("locations")), 5)


@query(EVENT_CATALOG_SQL.format(where=""))
def catalog_locations(spark, d):
    return _event_catalog(table(spark, d, "events"))


@query(EVENT_CATALOG_SQL.format(where="WHERE NOT regexp_matches(user_id || '', '^1.*$')"))
def catalog_scope_exclude(spark, d):
    from driftlattice.functions.paths import matches_any

    return _event_catalog(table(spark, d, "events").filter(~matches_any(F.col("user_id").cast("string"), ["1*"])))


# --- graphs ---------------------------------------------------------------------------------------------------------


@query(f"WITH {GRAPH_SQL} SELECT n AS node_count, e AS edge_count, round(CASE WHEN n < 2 THEN 0 ELSE e / (n::DOUBLE * (n - 1)) END, 9) AS density FROM (SELECT (SELECT count(*) FROM nodes)::BIGINT AS n, (SELECT count(*) FROM edges)::BIGINT AS e)")
def graph_density(spark, d):
    return rounded(graph.density(nodes_of(spark, d), edges_of(spark, d)), "density", places=9)


@query(f"WITH {GRAPH_SQL} SELECT id, count(source)::BIGINT AS out_degree FROM nodes LEFT JOIN edges ON id = source GROUP BY id")
def graph_out_degree(spark, d):
    return graph.out_degrees(nodes_of(spark, d), edges_of(spark, d))


@query(f"WITH {GRAPH_SQL} SELECT id, count(source)::BIGINT AS out_degree FROM nodes LEFT JOIN edges ON id = source GROUP BY id ORDER BY out_degree DESC, string_split(id, '/') LIMIT 10")
def graph_top_hubs(spark, d):
    return graph.top_hubs(nodes_of(spark, d), edges_of(spark, d))


RAW_SQL = "raw AS (SELECT l_partkey AS source, l_suppkey AS target FROM lineitem), known AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25)"


@query(f"WITH {RAW_SQL} SELECT DISTINCT source, target FROM raw WHERE source <> target AND source IN (SELECT id FROM known) AND target IN (SELECT id FROM known)")
def graph_edge_clean(spark, d):
    raw = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return graph.clean_edges(table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("id")), raw)


@query("SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem, (SELECT count(*) AS n FROM part) WHERE l_partkey <> l_suppkey AND l_partkey BETWEEN 0 AND n - 1 AND l_suppkey BETWEEN 0 AND n - 1")
def graph_index_edges(spark, d):
    return graph.index_edges(table(spark, d, "part").count(), table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")))


@query(f"WITH {GRAPH_SQL} SELECT source AS id, string_agg(target, ',' ORDER BY string_split(target, '/')) AS neighbours FROM edges GROUP BY source")
def graph_neighbours(spark, d):
    return graph.out_neighbours(edges_of(spark, d)).withColumn("neighbours", F.array_join("neighbours", ","))


@query(f"WITH RECURSIVE {GRAPH_SQL}, both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), r(id, component) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT a, min(x.component) FROM r x JOIN both_ways ON x.id = b JOIN recurring.r y ON y.id = a WHERE x.component < y.component GROUP BY a) SELECT id, component FROM r")
def graph_wcc(spark, d):
    return graph.weak_components(nodes_of(spark, d), edges_of(spark, d))


@query()
def graph_cycle_count(spark, d):
    return graph.cycle_counts(nodes_of(spark, d), edges_of(spark, d)).select("cycle_count")


@query()
def coupling_topology(spark, d):
    df = graph.coupling_topology(nodes_of(spark, d).select("id"), edges_of(spark, d))
    return df.withColumn("top_hubs", F.array_join(F.transform("top_hubs", lambda h: F.concat_ws("=", h["path"], h["out_degree"])), ","))


# --- change coupling ------------------------------------------------------------------------------------------------

COMMITS_SQL = "commits AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq, list(DISTINCT p_brand) AS files FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey, o_orderdate)"
RECENT_SQL = COMMITS_SQL + ", w AS (SELECT * FROM commits ORDER BY seq DESC LIMIT 500), f AS (SELECT seq, unnest(files) AS file FROM w), pairs AS (SELECT a.file AS source, b.file AS target, count(*)::BIGINT AS cochange_count FROM f a JOIN f b ON a.seq = b.seq AND a.file < b.file GROUP BY ALL)"


def commits_of(spark, d) -> DataFrame:
    from pyspark.sql import Window

    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    files = li.groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("files"))
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate").join(files, F.col("o_orderkey") == F.col("l_orderkey"))
    # order of commits: real histories come with one; here it is made from dates
    return df.select(F.struct("o_orderdate", "o_orderkey").alias("seq"), "files")


@query(f"WITH {RECENT_SQL} SELECT source, target, cochange_count, round(cochange_count / 500.0, 6) AS frequency FROM pairs WHERE cochange_count >= 2 AND cochange_count / 500.0 >= 0.03")
def change_coupling_pairs(spark, d):
    return rounded(coupling.change_coupling(commits_of(spark, d), 0.03, 500), "frequency")


@query(f"WITH {RECENT_SQL} SELECT (SELECT count(*) FROM w)::BIGINT AS commits_analyzed, (SELECT count(DISTINCT file) FROM f)::BIGINT AS distinct_files_touched")
def change_coupling_summary(spark, d):
    return coupling.summary(commits_of(spark, d), 500)


@query(f"WITH {RECENT_SQL}, n AS (SELECT DISTINCT p_brand AS id FROM part WHERE p_size <= 30) SELECT source, target, round(1 + cochange_count / 500.0, 6) AS weight FROM pairs WHERE cochange_count >= 2 AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)")
def coupling_weights(spark, d):
    pairs = coupling.change_coupling(commits_of(spark, d), 0.0, 500)
    n = table(spark, d, "part").filter("p_size <= 30").select(F.col("p_brand").alias("id")).distinct()
    return rounded(coupling.coupling_weights(pairs, n), "weight")


# --- boundaries -----------------------------------------------------------------------------------------------------

SPEC = [
    {"name": "all", "modules": ["**"], "allow_imports_from": ["first"]},
    {"name": "first", "modules": ["Brand#1?/**"], "allow_imports_from": ["second", "all"]},
    {"name": "second", "modules": ["Brand#2?/**", "Brand#3?/**"], "allow_imports_from": []},
    {"name": "inner", "modules": ["Brand#2[1-3]/**"], "allow_imports_from": ["second"]},
]
SPEC_SQL = "spec(boundary, len, rx) AS (VALUES ('all', 2, '^.*$'), ('first', 11, '^Brand#1.(/.+)$'), ('second', 11, '^Brand#2.(/.+)$'), ('second', 11, '^Brand#3.(/.+)$'), ('inner', 15, '^Brand#2[1-3](/.+)$')), allowed(f, t) AS (VALUES ('all', 'first'), ('first', 'second'), ('first', 'all'), ('inner', 'second'))"
ASSIGN_SQL = "b AS (SELECT id, boundary FROM (SELECT id, boundary, row_number() OVER (PARTITION BY id ORDER BY len DESC, boundary) AS rn FROM nodes JOIN spec ON regexp_matches(id, rx)) WHERE rn = 1)"
VIOLATIONS_SQL = f"{GRAPH_SQL}, {SPEC_SQL}, {ASSIGN_SQL}, v AS (SELECT x.boundary AS from_boundary, y.boundary AS to_boundary, source, target FROM edges JOIN b x ON source = x.id JOIN b y ON target = y.id WHERE x.boundary <> y.boundary AND NOT EXISTS (SELECT 1 FROM allowed WHERE f = x.boundary AND t = y.boundary))"


@query(f"WITH nodes AS ({NODES_SQL}), {SPEC_SQL}, {ASSIGN_SQL} SELECT id, boundary FROM b")
def boundary_assign(spark, d):
    return B.assign_boundaries(nodes_of(spark, d), B.spec_patterns(spark, SPEC))


def _violations(spark, d):
    return B.boundary_violations(nodes_of(spark, d), edges_of(spark, d), B.spec_patterns(spark, SPEC), B.spec_allowed(spark, SPEC))


@query(f"WITH {VIOLATIONS_SQL} SELECT * FROM v")
def boundary_violations(spark, d):
    return _violations(spark, d)


@query(f"WITH {VIOLATIONS_SQL} SELECT count(*)::BIGINT AS violation_count FROM v")
def boundary_violation_count(spark, d):
    return _violations(spark, d).agg(F.count(F.lit(1)).alias("violation_count"))


IDS = ["a/b", "", "a\\b", "./a", "a/", "/a", "a/../b", ".", "a/./b", "..", "a..b", "./a/"]
IDS_SQL = "ids(id) AS (SELECT * FROM (VALUES " + ", ".join(f"({_quoted(i)})" for i in IDS) + ") UNION ALL SELECT regexp_replace(url, '^https?:/', '') FROM pages)"


@query(f"WITH {IDS_SQL} SELECT id, CASE WHEN id = '' THEN 'empty' WHEN contains(id, '\\') THEN 'backslash' WHEN starts_with(id, './') THEN 'leading_dot_slash' WHEN ends_with(id, '/') THEN 'trailing_slash' WHEN starts_with(id, '/') THEN 'leading_slash' WHEN list_contains(string_split(id, '/'), '..') THEN 'parent_component' END AS problem FROM ids")
def validate_node_ids(spark, d):
    urls = table(spark, d, "pages").select(F.regexp_replace("url", "^https?:/", "").alias("id"))
    ids = spark.createDataFrame([(i,) for i in IDS], "id string").union(urls)
    return ids.withColumn("problem", node_id_problem(F.col("id")))


# --- weighted graphs and communities --------------------------------------------------------------------------------

COMMUNITY = "p_size % 5"
WEIGHTED_SQL = GRAPH_SQL + ", wx AS (SELECT least(source, target) AS u, greatest(source, target) AS v, count(*)::DOUBLE AS w FROM edges GROUP BY ALL)"
OF_SQL = WEIGHTED_SQL + f", a AS (SELECT id AS node, {COMMUNITY} AS community FROM nodes), e AS (SELECT wx.*, x.community AS cu, y.community AS cv FROM wx JOIN a x ON u = x.node JOIN a y ON v = y.node)"


def weighted_of(spark, d) -> DataFrame:
    return L.undirected(edges_of(spark, d))


def assignments_of(spark, d) -> DataFrame:
    return nodes_of(spark, d).select(F.col("id").alias("node"), (F.col("p_size") % 5).alias("community"))


@query(f"WITH {WEIGHTED_SQL} SELECT u, v, w FROM wx")
def undirected_collapse(spark, d):
    return weighted_of(spark, d)


@query(f"WITH {WEIGHTED_SQL}, s AS (SELECT u AS node, w FROM wx UNION ALL SELECT v, w FROM wx) SELECT node, sum(w) AS degree FROM s GROUP BY node")
def weighted_degree(spark, d):
    return L.weighted_degrees(weighted_of(spark, d))


GIVEN_SQL = "given AS (SELECT least(a, b) AS a, greatest(a, b) AS b, w FROM (SELECT x.id AS a, y.id AS b, 1 + x.p_size / 10.0::DOUBLE AS w FROM nodes x JOIN nodes y ON y.p_partkey = x.p_partkey + 1))"


@query(f"WITH {GRAPH_SQL}, {GIVEN_SQL} SELECT source, target, round(coalesce(w, 1.0), 6) AS weight FROM edges LEFT JOIN given ON a = least(source, target) AND b = greatest(source, target)")
def edge_weights(spark, d):
    n = nodes_of(spark, d)
    x, y = n.select(F.col("p_partkey").alias("k"), F.col("id").alias("source"), "p_size"), n.select((F.col("p_partkey") - 1).alias("k"), F.col("id").alias("target"))
    given = x.join(y, "k").select("source", "target", (1 + F.col("p_size") / F.lit(10.0)).alias("weight"))
    return rounded(L.weighted_edges(edges_of(spark, d), given), "weight")


@query("WITH k AS (SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS ordinal, l_partkey AS s, l_suppkey AS t, l_quantity AS w FROM lineitem), known AS (SELECT p_partkey AS id FROM part) SELECT least(s, t) AS source, greatest(s, t) AS target, arg_max(w, (ordinal, w)) AS weight FROM k WHERE s IN (SELECT id FROM known) AND t IN (SELECT id FROM known) GROUP BY ALL")
def caller_weight_keys(spark, d):
    li = table(spark, d, "lineitem")
    ordinal = F.struct((F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("o"), F.col("l_quantity").alias("w"))
    weights = li.select(ordinal.alias("ordinal"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_quantity").alias("weight"))
    return L.caller_weights(weights, table(spark, d, "part").select(F.col("p_partkey").alias("id")))


KEYS = ["a:b", "a:b:c", ":x", "nokey", "x:"]


@query("SELECT k, CASE WHEN instr(k, ':') > 0 THEN split_part(k, ':', 1) END AS source, CASE WHEN instr(k, ':') > 0 THEN k[instr(k, ':') + 1:] END AS target FROM (VALUES " + ", ".join(f"('{k}')" for k in KEYS) + ") AS v(k)")
def split_weight_keys(spark, d):
    source, target = scalars.split_weight_key(F.col("k"), ":")
    return spark.createDataFrame([(k,) for k in KEYS], "k string").select("k", source.alias("source"), target.alias("target"))


@query(f"WITH {OF_SQL}, s AS (SELECT community, count(*)::BIGINT AS size FROM a GROUP BY community), i AS (SELECT cu, sum(w) AS inner_w FROM e WHERE cu = cv AND u <> v GROUP BY cu) SELECT community, size, round(CASE WHEN size <= 1 THEN 1 ELSE coalesce(inner_w, 0) / (size::DOUBLE * (size - 1) / 2) END, 9) AS density FROM s LEFT JOIN i ON community = cu")
def community_density(spark, d):
    return rounded(L.community_density(weighted_of(spark, d), assignments_of(spark, d)), "density", places=9)


@query(f"WITH {OF_SQL}, m AS (SELECT sum(w) AS m FROM wx), l AS (SELECT cu AS c, sum(w) AS l FROM e WHERE cu = cv GROUP BY cu), s AS (SELECT c, sum(w) AS s FROM (SELECT cu AS c, w FROM e UNION ALL SELECT cv, w FROM e) GROUP BY c) SELECT round(coalesce(sum(coalesce(l, 0) / m - pow(s / (2 * m), 2)), 0), 9) AS modularity FROM s LEFT JOIN l USING (c), m")
def community_modularity(spark, d):
    return rounded(L.modularity(weighted_of(spark, d), assignments_of(spark, d)), "modularity", places=9)


@query(f"WITH nodes AS ({NODES_SQL}) SELECT {COMMUNITY} AS community, count(*)::BIGINT AS size FROM nodes GROUP BY 1")
def community_sizes(spark, d):
    return L.community_sizes(assignments_of(spark, d))


@query(f"WITH nodes AS ({NODES_SQL}) SELECT {COMMUNITY} AS community, string_agg(id, ',' ORDER BY id) AS members FROM nodes GROUP BY 1")
def community_members(spark, d):
    return L.community_members(assignments_of(spark, d)).withColumn("members", F.array_join("members", ","))


@query(f"WITH {OF_SQL} SELECT least(cu, cv) AS u, greatest(cu, cv) AS v, sum(w) AS w FROM e GROUP BY 1, 2")
def quotient_graph(spark, d):
    return L.quotient(weighted_of(spark, d), assignments_of(spark, d))


@query(f"WITH {OF_SQL} SELECT u, v, w FROM e WHERE cu = 0 AND cv = 0")
def induced_subgraph(spark, d):
    return L.induced(weighted_of(spark, d), assignments_of(spark, d).filter("community = 0"))


@query(f"WITH nodes AS ({NODES_SQL}) SELECT 'src/' || id AS path, {COMMUNITY} AS community FROM nodes WHERE p_size <= 20")
def path_partition(spark, d):
    nodes = nodes_of(spark, d).withColumn("path", F.concat(F.lit("src/"), "id"))
    return L.path_partition(nodes, assignments_of(spark, d).join(nodes.filter("p_size <= 20").select(F.col("id").alias("node")), "node", "left_semi"))


@query("SELECT l_orderkey, l_linenumber, l_quantity - l_extendedprice / 1000 * (l_tax * 1000) / (2 * 5000.0::DOUBLE) AS gain FROM lineitem")
def move_gain_modularity(spark, d):
    gain = scalars.modularity_gain(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_tax") * 1000, F.lit(5000.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", gain.alias("gain"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - (l_discount * 100 + 1) * l_linenumber, 6) AS gain FROM lineitem")
def move_gain_cpm(spark, d):
    gain = scalars.cpm_gain(F.col("l_quantity"), F.col("l_discount") * 100 + 1, F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(gain, 6).alias("gain"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN true ELSE l_quantity >= l_discount * 100 * (l_linenumber - l_linenumber * l_linenumber / 20.0::DOUBLE) END AS ok FROM lineitem")
def well_connected(spark, d):
    ok = scalars.well_connected(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_linenumber"), F.lit(20.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ok.alias("ok"))


def _touched(spark, d) -> tuple[DataFrame, DataFrame]:
    e = edges_of(spark, d)
    return e.select(F.explode(F.array("source", "target")).alias("id")).distinct(), e


@query()
def leiden_partition(spark, d):
    return L.leiden(*_touched(spark, d))


@query()
def leiden_weighted(spark, d):
    nodes, edges = _touched(spark, d)
    return L.leiden(nodes, edges.withColumn("weight", F.length("source") / 10.0))


@query()
def leiden_cpm(spark, d):
    nodes, edges = _touched(spark, d)
    return L.leiden(nodes, edges, quality="cpm", gamma=0.5)


@query()
def leiden_warm_start(spark, d):
    nodes, edges = _touched(spark, d)
    prior = assignments_of(spark, d).join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    return L.leiden(nodes, edges, prior=prior)


@query()
def detect_boundaries(spark, d):
    nodes, edges = _touched(spark, d)
    return L.detect_boundaries(nodes, edges)


# --- history --------------------------------------------------------------------------------------------------------

YEARS_SQL = "years AS (SELECT year(o_orderdate)::BIGINT AS seq, count(*) / 100000.0::DOUBLE AS density, count(DISTINCT o_custkey)::BIGINT AS community_count, CASE WHEN year(o_orderdate) >= 1997 THEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT END AS violation_count, avg(CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 ELSE 0.0 END)::DOUBLE AS convention_drift FROM orders GROUP BY 1, year(o_orderdate))"
CATS_SQL = "cc AS (SELECT year(o_orderdate)::BIGINT AS seq, o_orderpriority AS category, o_orderstatus AS f, count(*) AS n FROM orders WHERE NOT (year(o_orderdate) = 1996 AND o_orderpriority LIKE '1%') GROUP BY ALL), cats AS (SELECT seq, category, CASE WHEN count(*) <= 1 THEN 0 ELSE greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) END AS entropy, count(*) / sum(n)::DOUBLE AS convention_drift FROM cc GROUP BY ALL)"


def years_of(spark, d) -> DataFrame:
    y = F.year("o_orderdate").cast("long")
    df = table(spark, d, "orders").withColumn("seq", y).groupBy("seq").agg(
        (F.count(F.lit(1)) / 100000.0).alias("density"),
        F.countDistinct("o_custkey").alias("community_count"),
        F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("v"),
        F.avg(F.col("o_orderpriority").startswith("1").cast("double")).alias("convention_drift"),
    )
    return df.withColumn("violation_count", F.when(F.col("seq") >= 1997, F.col("v"))).drop("v")


def cats_of(spark, d) -> DataFrame:
    o = table(spark, d, "orders").withColumn("seq", F.year("o_orderdate").cast("long")).filter(~((F.col("seq") == 1996) & F.col("o_orderpriority").startswith("1")))
    counts = o.groupBy(F.struct("seq", F.col("o_orderpriority").alias("category")).alias("category"), F.col("o_orderstatus").alias("fingerprint")).agg(F.count(F.lit(1)).alias("count"))
    return patterns.category_metrics(counts).select("category.seq", "category.category", F.col("entropy_raw").alias("entropy"), "convention_drift")


_d = lambda c: f"{c} - lag({c}) OVER (ORDER BY seq)"
DELTA_SQL = f"{YEARS_SQL}, {CATS_SQL}, s AS (SELECT years.*, total_entropy FROM years JOIN (SELECT seq, sum(entropy) AS total_entropy FROM cats GROUP BY seq) USING (seq))"


@query(f"WITH {DELTA_SQL} SELECT seq, round({_d('total_entropy')}, 6) AS pattern_entropy_delta, round({_d('convention_drift')}, 6) AS convention_drift_delta, round({_d('density')}, 6) AS coupling_delta, {_d('community_count')} AS community_count_delta, {_d('violation_count')} AS boundary_violation_delta FROM s")
def snapshot_delta(spark, d):
    return rounded(divergence.snapshot_deltas(years_of(spark, d), cats_of(spark, d)), "pattern_entropy_delta", "convention_drift_delta", "coupling_delta")


@query("SELECT NULL::DOUBLE AS pattern_entropy_delta, NULL::DOUBLE AS convention_drift_delta, NULL::DOUBLE AS coupling_delta, NULL::BIGINT AS community_count_delta, NULL::BIGINT AS boundary_violation_delta")
def delta_null_first(spark, d):
    return divergence.null_summary(spark)


PER_SQL = f"{CATS_SQL}, per AS (SELECT category, coalesce(b.entropy, 0) - coalesce(a.entropy, 0) AS entropy_delta, coalesce(b.convention_drift, 0) - coalesce(a.convention_drift, 0) AS drift_delta FROM (SELECT * FROM cats WHERE seq = 1996) a FULL JOIN (SELECT * FROM cats WHERE seq = 1997) b USING (category))"


@query(f"WITH {PER_SQL} SELECT category, round(entropy_delta, 6) AS entropy_delta, round(drift_delta, 6) AS drift_delta FROM per")
def delta_per_category(spark, d):
    return rounded(divergence.category_deltas(cats_of(spark, d), 1996, 1997), "entropy_delta", "drift_delta")


OVERRIDES = [("1-URGENT", 0.5, None, "2099-01-01"), ("2-HIGH", -1.0, -1.0, "2020-01-01"), ("3-MEDIUM", None, -0.5, "2026-01-01"), ("5-LOW", -2.0, None, "soon")]
TODAY = datetime.date(2026, 1, 1)
OVERRIDES_SQL = "ov(category, er, dr, expires) AS (VALUES ('1-URGENT', 0.5::DOUBLE, NULL::DOUBLE, '2099-01-01'), ('2-HIGH', -1.0, -1.0, '2020-01-01'), ('3-MEDIUM', NULL, -0.5, '2026-01-01'), ('5-LOW', -2.0, NULL, 'soon')), on_ AS (SELECT *, coalesce(DATE '2026-01-01' <= try_cast(expires AS DATE), false) AS active FROM ov)"


def overrides_of(spark) -> DataFrame:
    return spark.createDataFrame(OVERRIDES, "category string, pattern_entropy_rate double, convention_drift_rate double, expires string")


@query(f"WITH {OVERRIDES_SQL} SELECT category, active, coalesce(try_cast(expires AS DATE), DATE '1970-01-01')::VARCHAR AS expires_on FROM on_")
def threshold_overrides(spark, d):
    return divergence.applied_overrides(overrides_of(spark), TODAY).select("category", "active", F.col("expires_on").cast("string").alias("expires_on"))


RATES = {"pattern_entropy": 0.01, "convention_drift": 0.0, "coupling_delta": -1.0, "boundary_violations": 1e9}


@query(
    f"WITH {DELTA_SQL}, x AS (SELECT seq, {_d('total_entropy')} AS pe, {_d('convention_drift')} AS cd, {_d('density')} AS de, {_d('violation_count')} AS bv FROM s), {PER_SQL.replace(CATS_SQL + ', ', '')}, {OVERRIDES_SQL}, "
    "t AS (SELECT 'pattern_entropy' AS dimension, NULL AS category, pe AS actual, 0.01 AS lim FROM x WHERE seq = 1997 UNION ALL SELECT 'convention_drift', NULL, cd, 0.0 FROM x WHERE seq = 1997 UNION ALL SELECT 'coupling_delta', NULL, de, -1.0 FROM x WHERE seq = 1997 UNION ALL SELECT 'boundary_violations', NULL, bv, 1e9 FROM x WHERE seq = 1997 "
    "UNION ALL SELECT 'pattern_entropy', per.category, entropy_delta, coalesce(er, 0.01) FROM per LEFT JOIN on_ ON per.category = on_.category AND active UNION ALL SELECT 'convention_drift', per.category, drift_delta, coalesce(dr, 0.0) FROM per LEFT JOIN on_ ON per.category = on_.category AND active) "
    'SELECT dimension, category, round(actual, 6) AS actual, lim::DOUBLE AS "limit" FROM t WHERE actual > lim + 1e-9'
)
def threshold_check(spark, d):
    cats = cats_of(spark, d)
    summary = divergence.snapshot_deltas(years_of(spark, d), cats).filter("seq = 1997")
    found = divergence.threshold_breaches(summary, divergence.category_deltas(cats, 1996, 1997), overrides_of(spark), RATES, TODAY)
    return rounded(found.drop("ordinal"), "actual")


TREND_SQL = "SELECT count(*)::BIGINT AS snapshot_count, round(avg(pe), 6) AS pattern_entropy_slope, round(avg(cd), 6) AS convention_drift_slope, round(avg(de), 6) AS coupling_slope, round(avg(cc), 6) AS community_count_slope FROM (SELECT {a} AS pe, {b} AS cd, {c} AS de, {e} AS cc FROM {t})"
_trend = lambda t: TREND_SQL.format(a=_d("total_entropy"), b=_d("convention_drift"), c=_d("density"), e=_d("community_count"), t=t)


def _series(spark, d) -> DataFrame:
    return years_of(spark, d).join(divergence.snapshot_entropy(cats_of(spark, d)), "seq")


_slopes = ("pattern_entropy_slope", "convention_drift_slope", "coupling_slope", "community_count_slope")


@query(f"WITH {DELTA_SQL} {_trend('s')}")
def trend_slopes(spark, d):
    return rounded(divergence.trend(_series(spark, d)), *_slopes)


@query(f"WITH {DELTA_SQL}, l AS (SELECT * FROM s ORDER BY seq DESC LIMIT 3) {_trend('l')}")
def trend_last_n(spark, d):
    return rounded(divergence.trend(_series(spark, d), 3), *_slopes)


# a part changes its group in the first two years only, if its size is a multiple of 7
PARTS_SQL = "pp AS (SELECT y AS snapshot_idx, p_partkey::VARCHAR AS node, (CASE WHEN p_size % 7 = 0 AND y <= 2 THEN p_size + y ELSE p_size END % 4 + y * 4)::INTEGER AS community FROM part, (SELECT unnest(range(1, 6)) AS y)), sets AS (SELECT snapshot_idx, community, string_agg(node, chr(1) ORDER BY node) AS members FROM pp GROUP BY ALL)"


def partitions_of(spark, d) -> DataFrame:
    p = table(spark, d, "part").select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("snapshot_idx"), F.col("p_partkey").cast("string").alias("node"), "p_size")
    y = F.col("snapshot_idx")
    moved = F.when((F.col("p_size") % 7 == 0) & (y <= 2), F.col("p_size") + y).otherwise(F.col("p_size"))
    return p.select("snapshot_idx", "node", (moved % 4 + y * 4).cast("int").alias("community"))


@query(f"WITH {PARTS_SQL}, k AS (SELECT snapshot_idx, string_agg(members, chr(2) ORDER BY members) AS k FROM sets GROUP BY snapshot_idx) SELECT round(coalesce(avg(CASE WHEN k = b THEN 1.0 ELSE 0.0 END), 0), 6) AS historical_stability FROM (SELECT k, lag(k) OVER (ORDER BY snapshot_idx) AS b FROM k) WHERE b IS NOT NULL")
def historical_stability(spark, d):
    return rounded(B.historical_stability(partitions_of(spark, d)), "historical_stability")


TAIL_SQL = PARTS_SQL + ", n AS (SELECT max(snapshot_idx) AS n FROM pp), hit AS (SELECT l.community, l.members, n + 1 - s.snapshot_idx AS back FROM sets l, n, sets s WHERE l.snapshot_idx = n AND s.members = l.members), tails AS (SELECT community, members, max(back)::BIGINT AS stable_snapshots FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY back) AS rn FROM hit) WHERE rn = back GROUP BY ALL)"


@query(f"WITH {TAIL_SQL} SELECT community, stable_snapshots FROM tails")
def stable_tail(spark, d):
    return B.stable_tails(partitions_of(spark, d)).select("community", "stable_snapshots")


@query(f"WITH {TAIL_SQL} SELECT community AS community_id, stable_snapshots, replace(members, chr(1), ',') AS node_ids FROM tails WHERE stable_snapshots >= 3")
def infer_boundaries(spark, d):
    return B.infer_boundaries(partitions_of(spark, d), 3).withColumn("node_ids", F.array_join("node_ids", ","))


@query("WITH a AS (SELECT p_partkey::VARCHAR AS node, p_type AS community FROM part), f AS (SELECT community, row_number() OVER (ORDER BY min(node)) - 1 AS number FROM a GROUP BY community) SELECT node, number::BIGINT AS community FROM a JOIN f USING (community)")
def renumber_communities(spark, d):
    return B.renumbered(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node"), F.col("p_type").alias("community")))


# --- store, times, texts --------------------------------------------------------------------------------------------

NAMES_SQL = "names AS (SELECT DISTINCT 'snapshot_' || strftime(o_orderdate, '%Y%m%d') || '.json' AS name FROM orders UNION ALL SELECT 'README.md')"


@query(f"WITH {NAMES_SQL} SELECT name, row_number() OVER (ORDER BY name DESC) <= 5 AS kept FROM names WHERE name LIKE 'snapshot_%.json'")
def retention_plan(spark, d):
    names = table(spark, d, "orders").select(F.concat(F.lit("snapshot_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".json")).alias("name")).distinct()
    return snapshots.retention_plan(names.union(spark.createDataFrame([("README.md",)], "name string")), 5)


@query("SELECT o_orderkey, replace(replace(replace(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), '-', ''), ':', ''), 'Z', '') AS safe FROM orders")
def iso_filename_safe(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "orders").select("o_orderkey", scalars.file_safe_time(iso).alias("safe"))


@query("SELECT event_id, strftime(make_timestamp((event_id * 86411)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def epoch_iso(spark, d):
    return table(spark, d, "events").select("event_id", scalars.epoch_iso(F.col("event_id") * 86411).alias("iso"))


TIMES = {"2026-04-29T12:34:56Z": "2026-04-29T12:34:56Z", "2026-04-29T12:34:56+02:00": "2026-04-29T10:34:56Z", "2026-01-01T00:30:00-05:00": "2026-01-01T05:30:00Z"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TIMES.items()) + ") AS v(time, utc)")
def normalize_to_utc(spark, d):
    return spark.createDataFrame([(t,) for t in TIMES], "time string").select("time", scalars.utc_iso(F.col("time")).alias("utc"))


DATES = {"2026-04-29": None, "2026-4-29": "format", "1969-01-01": "year", "2026-13-01": "month", "2026-02-29": None, "2026-02-30": "day", "2026-04-31": "day", "": "format", "2026-01-00": "day"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {_quoted(b) if b else 'NULL'})" for a, b in DATES.items()) + ") AS v(date, problem)")
def date_validate(spark, d):
    return spark.createDataFrame([(t,) for t in DATES], "date string").select("date", scalars.date_problem(F.col("date")).alias("problem"))


@query("WITH d AS (SELECT doc_id, text, list_transform(range(1, least(length(text), 256) + 1), lambda k: strlen(text[1:k])) AS ends FROM documents) SELECT doc_id, text[1:len(list_filter(ends, lambda e: e <= 256))] AS text FROM d")
def truncate_256(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.truncate_256(F.col("text")).alias("text"))


@query("SELECT DISTINCT p_type, CASE WHEN length(x) <> 64 THEN 'length' END AS problem FROM (SELECT p_type, CASE WHEN p_size % 2 = 0 THEN sha256(p_type) ELSE md5(p_type) END AS x FROM part)")
def hex_validate(spark, d):
    x = F.when(F.col("p_size") % 2 == 0, F.sha2("p_type", 256)).otherwise(F.md5("p_type"))
    return table(spark, d, "part").select("p_type", P.hex_problem(x).alias("problem")).distinct()


# --- repositories ---------------------------------------------------------------------------------------------------

REPOS = {
    "rust": ([("a/b/c.rs", ["super::super::models", "crate::utils", "std::fmt"]), ("a/models.rs", []), ("utils.rs", ["self::nothing"]), ("x/dup.rs", []), ("y/dup.rs", ["crate::dup"])], {}),
    "python": ([("main.py", ["pkg.models", "pkg", "space.inner", "os"]), ("pkg/__init__.py", ["."]), ("pkg/models.py", [".", "..main"]), ("space/inner/a.py", []), ("space/inner/b.py", ["...main"])], {}),
    "typescript": ([("app.ts", ["./lib", "@/lib/utils", "~lib", "react"]), ("lib/index.ts", ["./utils"]), ("lib/utils.ts", ["../app", "../../up"])], {"aliases": [("@/*", ["./*"]), ("~lib", ["./lib/index.ts"])]}),
    "javascript": ([("index.js", ["./utils", "./helpers.js"]), ("utils.js", ["./sub"]), ("helpers.js", []), ("sub/index.mjs", [])], {}),
    "go": ([("main.go", ["mymod/pkg", "fmt", "mymod"]), ("pkg/a.go", []), ("pkg/b.go", ["mymod/pkg/deep"]), ("pkg/deep/c.go", [])], {"go_module": "mymod"}),
    "java": ([("App.java", ["com.x.A", "com.x.*", "java.util.List"]), ("src/main/java/com/x/A.java", []), ("mod/src/main/java/com/x/B.java", ["com.x.A"])], {}),
}
EDGES = {
    "rust": [("a/b/c.rs", "a/models.rs"), ("a/b/c.rs", "utils.rs")],
    "python": [("main.py", "pkg/models.py"), ("main.py", "pkg/__init__.py"), ("main.py", "space/inner/a.py"), ("pkg/models.py", "pkg/__init__.py"), ("pkg/models.py", "main.py"), ("space/inner/b.py", "main.py")],
    "typescript": [("app.ts", "lib/index.ts"), ("app.ts", "lib/utils.ts"), ("lib/index.ts", "lib/utils.ts"), ("lib/utils.ts", "app.ts")],
    "javascript": [("index.js", "utils.js"), ("index.js", "helpers.js"), ("utils.js", "sub/index.mjs")],
    "go": [("main.go", "pkg/a.go"), ("main.go", "pkg/b.go"), ("pkg/b.go", "pkg/deep/c.go")],
    "java": [("App.java", "src/main/java/com/x/A.java"), ("App.java", "mod/src/main/java/com/x/B.java"), ("mod/src/main/java/com/x/B.java", "src/main/java/com/x/A.java")],
}
CODE = {
    "rust": ("lib.rs", "use std::fmt;\npub fn f(x: u8) -> u8 {\n    println!(\"x\");\n    match x { 0 => g()?, _ => 1 }\n}\n"),
    "python": ("m.py", "import os, sys as s\nfrom .a import b\n\nclass A:\n    def f(self):\n        try:\n            return [x for x in os.listdir('.')]\n        except OSError:\n            return print('no')\n"),
    "typescript": ("m.ts", "import { a } from './a';\nexport class B {}\nexport const f = async () => { await fetch('/x'); console.log(a?.b); };\n"),
    "javascript": ("m.js", "const u = require('./u');\nexport function f() { return u.map(x => x).filter(Boolean); }\n"),
    "go": ("m.go", "package m\n\nimport (\n\t\"fmt\"\n\tx \"mymod/x\"\n)\n\nfunc Run() {\n\tdefer x.Close()\n\tgo fmt.Println(\"a\")\n}\n"),
    "java": ("M.java", "import java.util.*;\nimport static a.B.c;\npublic class M {\n    public int f(int x) {\n        try { throw new E(); } catch (E e) { return 1; }\n    }\n}\n"),
}


def _repository(language: str):
    files, options = REPOS[language]

    def resolved(spark, d):
        records = spark.createDataFrame([(p, language, i) for p, i in files], "path string, language string, imports array<string>")
        return dependency_edges(records, **options)

    def extracted(spark, d):
        path, text = CODE[language]
        return adapters.feature_records(spark.createDataFrame([(path, bytearray(text.encode()))], "path string, content binary")).select(
            "path", "language", F.array_join("imports", ",").alias("imports"), F.array_join("exports", ",").alias("exports"), F.array_join("signatures", ";").alias("signatures"), F.array_join(F.array_sort(F.transform("pattern_hints", lambda h: h["node_kind"])), ",").alias("hints")
        )

    QUERIES[f"import_resolution_{language}"], QUERIES[f"extract_{language}"] = resolved, extracted
    SQL[f"import_resolution_{language}"] = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EDGES[language]) + ") AS v(source, target)"


for _language in REPOS:
    _repository(_language)


@query()
def catalog_of_code(spark, d):
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in CODE.values()], "path string, content binary")
    df = patterns.catalog(adapters.feature_records(files), 1)
    return df.select("category", "fingerprint", "count", F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["file"], x["start_row"], x["start_col"])), ",").alias("locations"))


@query()
def jsonc_strip(spark, d):
    texts = ['{"a": 1, // one\n "b": [1, 2,], /* two */ }', '{"url": "http://x//y", "c": "/* no */",}']
    return spark.createDataFrame([(t, scalars.without_comments(t)) for t in texts], "jsonc string, json string")


__all__ = ["QUERIES", "SQL", "resolve_imports"]
