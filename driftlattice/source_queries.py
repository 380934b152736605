"""The sources and sinks as queries: files are made from the test tables in the shared folder and read back."""

from __future__ import annotations

import datetime
import os
import uuid
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlattice.errors import ConfigError, SnapshotError
from driftlattice.functions import scalars
from driftlattice.functions.paths import order_key
from driftlattice.operators import boundaries as B
from driftlattice.operators import community as L
from driftlattice.queries import NODE, NODES_SQL, PARTS_SQL, TAIL_SQL, WEIGHTED_SQL, assignments_of, nodes_of, partitions_of, table, weighted_of
from driftlattice.session import checkpoint_dir
from driftlattice.sources import config, files, git, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def fresh_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, as a path of the file system."""
    home = checkpoint_dir(spark)
    path = os.path.join(home.removeprefix("file://").removeprefix("file:"), f"files-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


# --- snapshot store -------------------------------------------------------------------------------------------------

YEARS_SQL = "SELECT year(o_orderdate)::BIGINT - 1994 AS seq, year(o_orderdate) || '-12-31T00:00:00Z' AS timestamp, count(*)::BIGINT AS node_count, count(DISTINCT o_custkey)::BIGINT AS edge_count FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1999 GROUP BY ALL"


def store_of(spark: SparkSession, d: str) -> str:
    """A store with a snapshot for each of five years, a damaged one and a file that is none."""
    year = F.year("o_orderdate")
    years = table(spark, d, "orders").filter(year.between(1995, 1999)).groupBy(year.alias("y")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("e"))
    parts = partitions_of(spark, d).groupBy((F.col("snapshot_idx") + 1994).alias("y")).agg(F.map_from_entries(F.collect_list(F.struct("node", "community"))).alias("path_partition"))
    graph = F.struct(F.col("n").alias("node_count"), F.col("e").alias("edge_count"), (F.col("e") / F.col("n")).alias("density"), F.lit(0).alias("cycle_count"), F.lit(1).alias("component_count"))
    rows = years.join(parts, "y").select(F.lit(snapshots.VERSION).alias("snapshot_version"), F.concat("y", F.lit("-12-31T00:00:00Z")).alias("timestamp"), graph.alias("graph"), "path_partition")
    folder = fresh_folder(spark)
    snapshots.write_snapshots(rows, folder)
    Path(folder, "snapshot_19000101T000000_00000000.json").write_text('{"graph": {')
    Path(folder, "README.json").write_text("{}")
    return folder


@query(YEARS_SQL)
def snapshot_store_scan(spark, d):
    return snapshots.snapshot_table(spark, store_of(spark, d)).select(F.col("seq").cast("long").alias("seq"), "timestamp", "graph.node_count", "graph.edge_count")


def _summary(spark, found: list[dict]) -> DataFrame:
    return spark.createDataFrame([(s["timestamp"], s["graph"]["node_count"], s["graph"]["edge_count"]) for s in found], "timestamp string, node_count long, edge_count long")


@query(f"SELECT timestamp, node_count, edge_count FROM ({YEARS_SQL}) ORDER BY seq DESC LIMIT 1")
def snapshot_latest(spark, d):
    return _summary(spark, [snapshots.latest(store_of(spark, d))])


@query(f"SELECT timestamp, node_count, edge_count FROM ({YEARS_SQL}) UNION ALL SELECT 'damaged', 0, 0")
def snapshot_by_id(spark, d):
    """Each snapshot by its name, with and without its ending; the damaged one is an error."""
    folder, found = store_of(spark, d), []
    for k, path in enumerate(snapshots.listed(folder)):
        try:
            found.append(snapshots.by_id(folder, path.name if k % 2 else path.stem))
        except SnapshotError:
            found.append({"timestamp": "damaged", "graph": {"node_count": 0, "edge_count": 0}})
    return _summary(spark, found)


@query(f"WITH {PARTS_SQL} SELECT snapshot_idx::BIGINT AS snapshot_idx, node, community FROM pp WHERE snapshot_idx > 2")
def prior_partitions(spark, d):
    return snapshots.prior_partitions(snapshots.snapshot_table(spark, store_of(spark, d)), 3).withColumn("snapshot_idx", F.col("snapshot_idx").cast("long"))


@query(f"WITH {TAIL_SQL.replace('range(1, 6)', 'range(2, 6)')} SELECT community AS community_id, stable_snapshots, replace(members, chr(1), ',') AS node_ids FROM tails WHERE stable_snapshots >= 3")
def infer_from_store(spark, d):
    """Reads one snapshot more than the threshold asks for."""
    prior = snapshots.prior_partitions(snapshots.snapshot_table(spark, store_of(spark, d)), 4)
    return B.infer_boundaries(prior, 3).withColumn("node_ids", F.array_join("node_ids", ","))


@query("SELECT p_brand AS graph, p_partkey::VARCHAR AS node, (p_size % 5)::BIGINT AS community FROM part UNION ALL SELECT 'missing', NULL, NULL UNION ALL SELECT 'damaged', NULL, NULL")
def partition_cache(spark, d):
    """A cache file for each brand, written and read back by its task; what is missing or damaged is a cold start."""
    folder = fresh_folder(spark)
    Path(folder, "damaged.json").write_text('{"assignments": [1')

    def cached(key, own: pd.DataFrame) -> pd.DataFrame:
        path = Path(folder, f"{key[0].replace('#', '_')}.json")
        snapshots.save_partition(path, dict(zip(own["node"], own["community"].tolist(), strict=True)))
        found = snapshots.load_partition(path)
        return pd.DataFrame({"graph": key[0], "node": list(found), "community": list(found.values())})

    parts = table(spark, d, "part").select(F.col("p_brand").alias("graph"), F.col("p_partkey").cast("string").alias("node"), (F.col("p_size") % 5).cast("long").alias("community"))
    cold = [(n, None, None) for n in ("missing", "damaged") if snapshots.load_partition(Path(folder, f"{n}.json")) is None]
    schema = "graph string, node string, community long"
    return parts.groupBy("graph").applyInPandas(cached, schema).union(spark.createDataFrame(cold, schema))


@query(f"WITH {TAIL_SQL} SELECT 'community_' || community AS name, replace(members, chr(1), ',') AS modules, 0::BIGINT AS n_allowed FROM tails WHERE stable_snapshots >= 3")
def boundary_ratify(spark, d):
    rows = B.ratified_rows(B.infer_boundaries(partitions_of(spark, d), 3))
    return rows.select("name", F.array_join("modules", ",").alias("modules"), F.size("allow_imports_from").cast("long").alias("n_allowed"))


# --- git, configuration, files --------------------------------------------------------------------------------------


@query("SELECT md5(o_orderkey::VARCHAR) AS commit_sha, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS commit_date, coalesce(files, '') AS files FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(replace(p_brand, '#', '/') || '/' || p_partkey, ',' ORDER BY l_linenumber, p_partkey) AS files FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def git_log_commits(spark, d):
    """A log for each customer, in which an order is a commit and its parts are files (with backslashes and `./`)."""
    nul = F.lit("\0")
    path = F.concat(F.lit("./"), F.regexp_replace("p_brand", "#", "\\\\"), F.lit("/"), F.col("p_partkey"))
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    touched = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_partkey", path.alias("path")))).alias("files"))
    orders = table(spark, d, "orders").join(touched, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    names = F.array_join(F.transform(F.coalesce("files", F.array().cast(touched.schema["files"].dataType)), lambda f: F.concat(f["path"], nul)), "")
    text = F.concat(F.lit(git.MARK), nul, F.md5(F.col("o_orderkey").cast("string")), nul, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), nul, F.lit("\n"), names)
    logs = orders.groupBy("o_custkey").agg(F.concat_ws("\0", F.collect_list(text)).alias("log"))
    commits = git.parsed_logs(logs).select(F.explode("commits").alias("c")).select("c.*")
    return commits.withColumn("files", F.array_join("files", ","))


@query("SELECT DISTINCT p_brand[1:7] AS file, 'src/app' AS base, '@' || p_brand || '/*' AS pattern, 'lib//' || p_brand || '/*' AS target FROM part")
def tsconfig_aliases(spark, d):
    """A tsconfig with comments, trailing commas and a key of two stars for each first digit of brands."""
    entry = F.concat(F.lit('"@'), "p_brand", F.lit('/*": ["lib//'), "p_brand", F.lit('/*", ] /* one brand */\n'))
    own = table(spark, d, "part").select(F.substring("p_brand", 1, 7).alias("file"), "p_brand").distinct()
    head = '{ // "compilerOptions": 0\n "compilerOptions": {"baseUrl": "./src/./app", "paths": {"*/two/*": ["x"],'
    text = F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("},},}"))

    @F.pandas_udf("array<struct<base:string,pattern:string,target:string>>")
    def parse(texts: pd.Series) -> pd.Series:
        read = texts.map(config.parse_aliases)
        return read.map(lambda r: [{"base": r[0], "pattern": p, "target": t} for p, ts in r[1] for t in ts])

    return own.groupBy("file").agg(text.alias("text")).select("file", F.explode(parse("text")).alias("a")).select("file", "a.*")


CONFIG_SQL = """SELECT n_name AS nation, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE (CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 100 END)::BIGINT END AS retention,
  CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE round(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey / 100.0 ELSE 0.6 END, 6)::DOUBLE END AS min_frequency,
  CASE WHEN n_nationkey % 5 = 4 THEN NULL WHEN n_nationkey % 7 = 0 THEN '/env/' || n_nationkey ELSE '.driftlattice/snapshots' END AS dir,
  CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE (CASE WHEN n_nationkey < 12 THEN 1 ELSE 2 END)::BIGINT END AS n_overrides,
  CASE WHEN n_nationkey % 10 = 4 THEN 'thresholds.overrides.x.expires' WHEN n_nationkey % 10 = 9 THEN 'change_coupling.min_frequency' END AS fault FROM nation"""


@query(CONFIG_SQL)
def config_layers(spark, d):
    """A user's and a project's file for each nation: the project's wins by key, overrides merge by category, expired ones
    go, and faults name their key."""
    folder = fresh_folder(spark)

    def load(batches):
        for b in batches:
            rows = []
            for name, k in zip(b["n_name"], b["n_nationkey"], strict=True):
                home = Path(folder, str(k))
                home.mkdir(exist_ok=True)
                user, project = home / "user.toml", home / "project.toml"
                user.write_text((f"[snapshots]\nretention = {k}\n" if k % 2 == 0 else "") + f'[thresholds.overrides.y]\npattern_entropy_rate = 1.0\nexpires = "20{14 + k}-06-30"\n')
                project.write_text("[change_coupling]\n" + (f"min_frequency = {k / 100}\n" if k % 3 == 0 else "min_frequency = 1.5\n" if k % 10 == 9 else "") + "[thresholds.overrides.x]\n" + ("" if k % 10 == 4 else 'expires = "2099-01-01"\n'))
                if k % 10 == 9:
                    project.write_text(project.read_text().replace(f"min_frequency = {k / 100}", "min_frequency = 1.5"))
                try:
                    c = config.load_config(home, user, project, {"DRIFTLATTICE_SNAPSHOT_DIR": f"/env/{k}"} if k % 7 == 0 else {}, datetime.date(2026, 6, 30))
                    rows.append((name, c["snapshots"]["retention"], c["change_coupling"]["min_frequency"], c["snapshots"]["dir"], len(c["thresholds"]["overrides"]), None))
                except ConfigError as e:
                    rows.append((name, None, None, None, None, e.key))
            yield pd.DataFrame(rows, columns=["nation", "retention", "min_frequency", "dir", "n_overrides", "fault"], dtype=object)

    return table(spark, d, "nation").select("n_name", "n_nationkey").mapInPandas(load, "nation string, retention long, min_frequency double, dir string, n_overrides long, fault string")


@query("SELECT r_name AS boundary, coalesce(string_agg(n_name || '/**', ',' ORDER BY n_name), '') AS modules, CASE WHEN r_regionkey > 0 THEN (SELECT min(r_name) FROM region WHERE r_regionkey = 0) ELSE '' END AS allowed FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey UNION ALL SELECT 'comments are lost', 'true', ''")
def boundary_spec_file(spark, d):
    """A specification of a boundary for each region, written twice (over comments) and read back."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    regions = {r.r_regionkey: r for r in table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").collect()}  # one row a region
    spec = {"version": "1.0", "boundaries": [{"name": r.r_name, "modules": [f"{x}/**" for x in r.names or []], "allow_imports_from": [regions[0].r_name] if k else []} for k, r in regions.items()]}
    path = Path(fresh_folder(spark), "boundaries.yaml")
    path.write_text("# by hand\nboundaries: []\n")
    lost = config.write_boundaries(path, spec)
    rows = [(b["name"], ",".join(b["modules"]), ",".join(b["allow_imports_from"])) for b in config.read_boundaries(path)]
    return spark.createDataFrame([*rows, ("comments are lost", str(lost).lower(), "")], "boundary string, modules string, allowed string")


@query(
    "WITH f AS (SELECT replace(n_name, ' ', '_') || '/' || CASE WHEN n_nationkey % 6 = 5 THEN '.hidden' ELSE 'file' END || CASE n_nationkey % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.tsx' ELSE '.txt' END AS path, n_name FROM nation) "
    "SELECT path, CASE WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.py' THEN 'python' ELSE 'typescript' END AS language, n_name AS text FROM f WHERE path NOT LIKE '%.txt' AND path NOT LIKE 'A%' AND (path NOT LIKE '%/file.py' OR path LIKE 'I%')"
)
def repository_walk(spark, d):
    """A repository with a file for each nation: ignored ones, one that an ignore file brings back, hidden and excluded ones."""
    root = Path(fresh_folder(spark))
    (root / ".git").mkdir()
    (root / ".gitignore").write_text("# python\nfile.py\n!/I*/file.py\n")
    for r in table(spark, d, "nation").collect():  # one file a nation
        path = root / r.n_name.replace(" ", "_") / ((".hidden" if r.n_nationkey % 6 == 5 else "file") + (".rs", ".py", ".tsx", ".txt")[r.n_nationkey % 4])
        path.parent.mkdir()
        path.write_text(r.n_name)
    found = files.routed(files.repository_files(spark, str(root), exclude=["A*/**"]))
    return found.select("path", "language", F.col("content").cast("string").alias("text"))


# --- keys, texts, orders --------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'not_finite' WHEN 2 THEN 'not_finite' WHEN 3 THEN 'negative' WHEN 4 THEN 'missing' WHEN 5 THEN 'not_finite' END AS problem FROM lineitem")
def weight_problems(spark, d):
    n, x = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    weight = F.when(n == 1, float("nan")).when(n == 2, float("inf")).when(n == 3, -x - 1).when(n == 4, None).when(n == 5, float("-inf")).otherwise(x - x)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.weight_problem(weight).alias("problem"))


@query("SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS source, l_suppkey || ':' || l_linenumber || chr(1) AS target FROM lineitem UNION ALL SELECT -1, 0, NULL, NULL")
def nul_weight_keys(spark, d):
    """Keys of two ids with a NUL between them; what follows the first one is the target, whatever it holds."""
    li = table(spark, d, "lineitem")
    target = F.concat(F.col("l_suppkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"), F.lit("\1"))
    keyed = li.select("l_orderkey", "l_linenumber", scalars.weight_key(F.col("l_partkey").cast("string"), target).alias("k"))
    kinds = {f.name: f.dataType for f in keyed.schema.fields}
    keyed = keyed.union(spark.range(1).select(F.lit(-1).cast(kinds["l_orderkey"]), F.lit(0).cast(kinds["l_linenumber"]), F.lit("none")))
    source, rest = scalars.split_weight_key(F.col("k"))
    return keyed.select("l_orderkey", "l_linenumber", source.alias("source"), rest.alias("target"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN p_type WHEN 2 THEN p_type END AS content FROM part")
def string_contents(spark, d):
    """What stands between the quotes of literals: of three kinds, empty, and without an end."""
    k, t = F.col("p_partkey") % 5, F.col("p_type")
    quoted = lambda q: F.concat(F.lit(q), t, F.lit(q))
    literal = F.when(k == 0, quoted('"')).when(k == 1, quoted("'")).when(k == 2, F.concat(F.lit(" "), quoted("`"))).when(k == 3, F.lit('""')).otherwise(F.concat(F.lit('"'), t))
    content = F.pandas_udf(lambda x: x.map(scalars.string_content), "string")
    return table(spark, d, "part").select("p_partkey", content(literal).alias("content"))


@query(f"SELECT id, row_number() OVER (PARTITION BY p_size ORDER BY string_split(id, '/'))::BIGINT AS place FROM (SELECT {NODE} AS id, p_size FROM part)")
def path_order(spark, d):
    """Paths in order of their components: a folder's files stand together, whatever characters follow its name."""
    place = F.row_number().over(Window.partitionBy("p_size").orderBy(order_key(F.col("id"))))
    return nodes_of(spark, d).select("id", place.cast("long").alias("place"))


@query(f"WITH nodes AS ({NODES_SQL}), s AS (SELECT count(*) AS n FROM nodes GROUP BY p_size % 5) SELECT sum(n)::BIGINT AS node_count, count(*)::BIGINT AS community_count, max(n)::BIGINT AS largest_community_size FROM s")
def partition_stats(spark, d):
    return L.partition_stats(assignments_of(spark, d))


@query(f"WITH {WEIGHTED_SQL}, p AS (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON y.p_partkey = (x.p_partkey * 7) % 1000 + 1) SELECT a, b, coalesce(w, 0)::DOUBLE AS weight FROM p LEFT JOIN wx ON u = least(a, b) AND v = greatest(a, b)")
def edge_weight_lookup(spark, d):
    n = nodes_of(spark, d)
    x = n.select(((F.col("p_partkey") * 7) % 1000 + 1).alias("k"), F.col("id").alias("a"))
    return L.edge_weights(weighted_of(spark, d), x.join(n.select(F.col("p_partkey").alias("k"), F.col("id").alias("b")), "k").select("a", "b"))


__all__ = ["QUERIES", "SQL"]
