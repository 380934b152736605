"""Operators over small inputs with known results."""

import datetime
import json
import subprocess
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlattice.functions import classify, scalars
from driftlattice.functions.fingerprint import FINGERPRINT_KEY, blake3, node_kind_fingerprint, tree_fingerprint
from driftlattice.functions.paths import glob_regex, node_id_problem
from driftlattice.operators import boundaries as B
from driftlattice.operators import community as L
from driftlattice.operators import coupling, divergence, graph, patterns
from driftlattice.operators.resolve import dependency_edges
from driftlattice.queries import CODE, EDGES, REPOS
from driftlattice.sources import adapters, config, git, snapshots


def nodes(spark, *ids):
    return spark.createDataFrame([(i, i, "rust") for i in ids], "id string, path string, language string")


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, target string")


def test_blake3_vectors():
    data = bytes(i % 251 for i in range(5000))
    assert blake3(b"").hex().startswith("af1349b9f5f9a1a6a0404dea36dcc949")
    assert blake3(data[:1025]).hex().startswith("d00278ae47eb27b34faecf67b4fe263f")
    assert blake3(b"", b"whats the Elvish word for friend").hex().startswith("92b2b75604ed3c761f9d6f62392c8a92")


def test_fingerprints():
    assert len(FINGERPRINT_KEY) == 32
    assert tree_fingerprint("a") == node_kind_fingerprint("a")
    assert tree_fingerprint("a", [("b", [])]) != tree_fingerprint("a", [("c", [])])
    assert tree_fingerprint("a", [("b", []), ("c", [])]) != tree_fingerprint("a", [("c", []), ("b", [])])


def test_mutual_edge_is_one_cycle(spark):
    n, e = nodes(spark, "A", "B"), edges(spark, ("A", "B"), ("B", "A"), ("A", "A"), ("A", "X"), ("A", "B"))
    row = graph.coupling_topology(n, e).head()
    assert (row.node_count, row.edge_count, row.density, row.cycle_count, row.component_count) == (2, 2, 1.0, 1, 1)
    assert [h.path for h in row.top_hubs] == ["A", "B"]


def test_components_and_empty_graph(spark):
    assert graph.component_count(nodes(spark, "a", "b", "c"), edges(spark)).head()[0] == 3
    assert graph.density(nodes(spark), edges(spark)).head().density == 0.0
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)]
    found = graph.weak_components(nodes(spark, *[f"n{i:02}" for i in range(21)], "z"), edges(spark, *chain)).collect()
    assert {r.component for r in found} == {"n00", "z"}


def test_components_by_rounds(spark):
    """Links of a chain, a star and pairs, by rounds alone and by a task, beside ids that are no nodes."""
    pairs = [(f"c{i}", f"c{(i * 7 + 7) % 29}") for i in range(28)] + [("s9", f"s{i}") for i in range(9)] + [("p0", "p1"), ("q0", "x"), ("x", "q1")]
    ids = sorted({v for p in pairs for v in p} - {"x"}) + ["z"]
    of = {v: v for p in pairs for v in p} | {"z": "z"}
    for _ in pairs:
        for a, b in pairs:
            of[a] = of[b] = min(of[a], of[b])
    for most in (0, 1 << 19):
        assert {r.id: r.component for r in graph.weak_components(nodes(spark, *ids), edges(spark, *pairs), most).collect()} == {i: of[i] for i in ids}


def test_back_edges_in_little_memory():
    """A path of 100,000 nodes with links back from each to the two before it: the search is as deep as the path."""
    n = 100_000
    links = [(a, b) for a in range(n) for b in (a - 2, a - 1, a + 1) if 0 <= b < n]
    s, t = (pa.array([x[k] for x in links], pa.int32()) for k in (0, 1))
    batches = [pa.record_batch([pa.array([0] * len(s[k : k + 9999])), s[k : k + 9999], t[k : k + 9999]], names=["first", "s", "t"]) for k in range(0, len(s), 9999)]
    tracemalloc.start()
    (found,) = graph.count_cycles(iter(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [{"first": 0, "cycle_count": 2 * n - 3}] and peak < 100 * n


def test_graph_queries_see_all_lines(spark, tmp_path):
    from driftlattice import queries

    orders = {1: [1, 2, 3, 1], 2: [4, 5, 6, 4], 3: [3, 4], 4: [7]}  # two triangles, a link between them, a node alone
    lines = [(o, n, p, 1.0) for o, ps in orders.items() for n, p in enumerate(ps, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, "b", "t", i) for i in range(1, 8)], "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert run("graph_cycle_count")[0].cycle_count == 2
    row = run("coupling_topology")[0]
    assert (row.node_count, row.edge_count, row.cycle_count, row.component_count) == (7, 7, 2, 2)
    for name in ("leiden_partition", "leiden_weighted", "leiden_cpm", "leiden_warm_start", "detect_boundaries"):
        groups: dict = {}
        for node, community, *_ in run(name):
            groups.setdefault(community, set()).add(node)
        assert sum(map(len, groups.values())) == 6, name
        assert name == "leiden_cpm" or sorted(map(sorted, groups.values())) == [["b/t/1", "b/t/2", "b/t/3"], ["b/t/4", "b/t/5", "b/t/6"]], name


def test_unknown_nodes_and_numbers_out_of_range_go(spark):
    pairs = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (2, 0), (0, 3), (-1, 2), (2, None)], "source long, target long")
    assert {tuple(r) for r in graph.index_edges(3, pairs).collect()} == {(0, 1), (2, 0)}
    given = spark.createDataFrame([(1, "a", "b", 1.0), (2, "b", "a", 2.0), (3, "a", "x", 3.0), (4, "x", "y", 4.0)], "ordinal long, source string, target string, weight double")
    assert [tuple(r) for r in L.caller_weights(given, nodes(spark, "a", "b", "c")).collect()] == [("a", "b", 2.0)]


def test_truncate(spark):
    texts = [None, "", "a" * 256, "a" * 257, *["x" * k + c * 100 for c in "é€😀" for k in range(4)]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.truncate_256(F.col("t")).alias("cut")).collect()
    assert all(r.cut == (None if r.t is None else r.t.encode()[:256].decode("utf-8", "ignore")) for r in rows)


def test_times_after_the_year_9999(spark):
    row = spark.range(1).select(scalars.epoch_iso(F.lit(253402300799)), scalars.epoch_iso(F.lit(253402300800)), scalars.epoch_iso(F.lit(6000000 * 86411)), scalars.utc_iso(F.lit("9999-12-31T23:30:00-02:00"))).head()
    assert list(row) == ["9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "18399-07-14T21:20:00Z", "10000-01-01T01:30:00Z"]


def test_path_order_of_hubs(spark):
    top = graph.top_hubs(nodes(spark, "a-b/x", "a/x"), edges(spark), 1).head()
    assert top.id == "a/x"


def test_entropies(spark):
    rows = [("c", "aaa", 1), ("c", "bbb", 1), ("d", "aaa", 2)]
    m = {r.category: r for r in patterns.category_metrics(spark.createDataFrame(rows, "category string, fingerprint string, count long")).collect()}
    assert m["c"].entropy_raw == pytest.approx(1.0) and m["c"].entropy_normalized == pytest.approx(1.0) and m["c"].convention_drift == 1.0
    assert m["d"].entropy_raw == 0.0 and m["d"].convention_drift == 0.5
    none = spark.createDataFrame([], "category string, fingerprint string")
    t = patterns.totals(patterns.pattern_metrics(none)).head()
    assert (t.total_entropy, t.convention_drift) == (0.0, 0.0)


def test_change_coupling_uses_the_tail(spark):
    commits = spark.createDataFrame([(0, ["c", "d"]), (1, ["b", "a", "a"]), (2, ["a", "b"])], "seq long, files array<string>")
    got = [tuple(r) for r in coupling.change_coupling(commits, 0.6, 2).collect()]
    assert got == [("a", "b", 1.0, 2)]
    assert coupling.change_coupling(commits, 0.0, 0).count() == 0
    with pytest.raises(ValueError):
        coupling.change_coupling(commits, 1.5)


def test_boundaries(spark):
    spec = [{"name": "all", "modules": ["crates/**"]}, {"name": "api", "modules": ["crates/api/**"], "allow_imports_from": ["x"]}]
    n = nodes(spark, "crates/api/a", "crates/b", "other")
    assert {r.id: r.boundary for r in B.assign_boundaries(n, B.spec_patterns(spark, spec)).collect()} == {"crates/api/a": "api", "crates/b": "all"}
    e = edges(spark, ("crates/api/a", "crates/b"), ("crates/api/a", "crates/b"), ("crates/b", "other"))
    assert B.boundary_violations(n, e, B.spec_patterns(spark, spec), B.spec_allowed(spark, spec)).count() == 2
    with pytest.raises(ValueError):
        B.spec_patterns(spark, [{"name": "bad", "modules": ["a[b"]}])


def test_allow_list_is_not_transitive(spark):
    spec = [{"name": x, "modules": [f"{x}/**"], "allow_imports_from": [y]} for x, y in (("a", "b"), ("b", "c"), ("c", "c"))]
    found = B.boundary_violations(nodes(spark, "a/1", "b/1", "c/1"), edges(spark, ("a/1", "c/1"), ("a/1", "b/1")), B.spec_patterns(spark, spec), B.spec_allowed(spark, spec)).collect()
    assert [(r.from_boundary, r.to_boundary) for r in found] == [("a", "c")]


@pytest.mark.parametrize(("glob", "yes", "no"), [("src/*", "src/a/b", "x/src/a"), ("**/x", "a/b/x", "a/xy"), ("a?c", "a/c", "ac"), ("[!a]b", "cb", "ab"), ("{a,b}/c", "b/c", "c/c"), ("a/**", "a/b", "a")])
def test_globs(glob, yes, no):
    import re

    assert re.match(glob_regex(glob), yes) and not re.match(glob_regex(glob), no)


def test_inference(spark):
    def parts(*snapshots_):
        return spark.createDataFrame([(i, n, c) for i, s in enumerate(snapshots_) for n, c in s.items()], "snapshot_idx int, node string, community int")

    same = parts({"a": 0, "b": 0}, {"a": 5, "b": 5}, {"a": 1, "b": 1})
    assert [(r.stable_snapshots, r.node_ids) for r in B.infer_boundaries(same, 2).collect()] == [(3, ["a", "b"])]
    assert B.infer_boundaries(parts({"a": 0}, {"a": 0}), 3).count() == 0
    assert B.infer_boundaries(parts({"a": 0}), 1).count() == 0
    assert B.infer_boundaries(same, 0).count() == 0
    assert B.historical_stability(same).head()[0] == 1.0
    assert B.historical_stability(parts({"a": 0})).head()[0] == 0.0


def test_delta_and_trend(spark):
    snaps = spark.createDataFrame([(1, 0.1, 3, 1, 0.5), (2, 0.3, 5, 3, 0.5)], "seq long, density double, community_count long, violation_count long, convention_drift double")
    cats = spark.createDataFrame([], "seq long, category string, entropy double, convention_drift double")
    first, second = divergence.snapshot_deltas(snaps, cats).orderBy("seq").collect()
    assert first.coupling_delta is None and first.boundary_violation_delta is None
    assert second.coupling_delta == pytest.approx(0.2) and second.community_count_delta == 2 and second.boundary_violation_delta == 2
    series = snaps.withColumn("total_entropy", F.lit(0.0))
    assert divergence.trend(series).head().coupling_slope == pytest.approx(0.2)
    none = divergence.trend(series, 0).head()
    assert none.snapshot_count == 0 and none.coupling_slope is None


def test_thresholds(spark):
    summary = spark.createDataFrame([(2.0 + 1e-10, None, 0.2, 1, None)], "pattern_entropy_delta double, convention_drift_delta double, coupling_delta double, community_count_delta long, boundary_violation_delta long")
    cats = spark.createDataFrame([("a", 1.0, 0.0), ("b", 3.0, 0.0)], "category string, entropy_delta double, drift_delta double")
    overrides = spark.createDataFrame([("a", 0.5, None, "2026-01-01"), ("b", 9.0, None, "soon")], "category string, pattern_entropy_rate double, convention_drift_rate double, expires string")
    got = [(r.dimension, r.category, r.limit) for r in divergence.threshold_breaches(summary, cats, overrides, today=datetime.date(2026, 1, 1)).collect()]
    assert got == [("coupling_delta", None, 0.15), ("pattern_entropy", "a", 0.5), ("pattern_entropy", "b", 2.0)]
    assert divergence.threshold_breaches(summary, cats, overrides).filter("category = 'a'").count() == 0  # by default every override is over


def ring(k, s):
    links = {(c * s + i, c * s + j): 1.0 for c in range(k) for i in range(s) for j in range(i + 1, s)}
    for c in range(k):
        a, b = c * s + s - 1, (c + 1) % k * s
        links[min(a, b), max(a, b)] = 1.0
    return L.Network(k * s, links)


@pytest.mark.parametrize(("k", "s", "q"), [(5, 10, 0.778261), (10, 50, 0.899184), (50, 100, 0.979798)])
def test_leiden_quality(k, s, q):
    net = ring(k, s)
    of = L.Leiden().run(net)
    inner = sum(w for a in range(net.n) for b, w in net.near[a].items() if a < b and of[a] == of[b])
    sigma = {}
    for v, c in enumerate(of):
        sigma[c] = sigma.get(c, 0) + net.degree[v]
    found = inner / net.total - sum((x / 2 / net.total) ** 2 for x in sigma.values())
    assert found == pytest.approx(q, rel=0.01) and abs(len(set(of)) - k) <= k / 10


def test_leiden_takes_components_one_by_one(spark):
    """Components are tasks of their own with the total weight of their graph; communities are numbered by first nodes."""
    own = ring(5, 6)
    links = [(f"{k}/{a}", f"{k}/{b}", w) for k in "xyz" for a in range(own.n) for b, w in own.near[a].items() if a < b]
    ids = sorted({v for a, b, _ in links for v in (a, b)}) + ["zz"]
    weighted = spark.createDataFrame(links, "source string, target string, weight double")
    prior = spark.createDataFrame([(i, int(i.split("/")[1]) // 6) for i in ids if i != "zz"], "node string, community long")  # the same five in each
    for given in (None, prior):
        found = {r.node: r.community for r in L.leiden(nodes(spark, *ids), weighted, prior=given).collect()}
        assert set(found) == set(ids) and list(dict.fromkeys(found[i] for i in ids)) == list(range(len(set(found.values()))))
        assert len({(i.split("/")[0], c) for i, c in found.items()}) == len(set(found.values())) == 16
    graphs = weighted.selectExpr("substr(source, 1, 1) AS g", "*")
    of = {tuple(r)[:2]: r.community for r in L.leiden(graphs.selectExpr("g", "source AS id").union(graphs.selectExpr("g", "target")).distinct(), graphs, graph="g").collect()}
    order = sorted(range(own.n), key=str)
    alone = L.Leiden().run(L.Network(own.n, {(min(a, b), max(a, b)): w for a in range(own.n) for b, w in ((order.index(u), w) for u, w in own.near[order[a]].items())}))
    assert all([of[k, f"{k}/{x}"] for x in order] == alone for k in "xyz")


def test_a_network_is_flat(monkeypatch):
    """A link takes a few bytes at each of its ends."""
    monkeypatch.setattr(L, "LINKS_AT_ONCE", 1 << 14)
    n, near = 20_000, 10
    s = np.repeat(np.arange(n), near)
    t = (s + np.tile(np.arange(1, near + 1), n)) % n
    s, t = np.concatenate([s, t]), np.concatenate([t, s])
    order = np.lexsort((t, s))
    s, t = s[order].astype(np.int32), t[order].astype(np.int32)
    head = pa.record_batch([pa.array([0]), pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([n * near * 1.0])], names=["component", "s", "t", "w"])
    rest = [pa.record_batch([pa.array([0] * len(s[k : k + 9999])), pa.array(s[k : k + 9999]), pa.array(t[k : k + 9999]), pa.array([1.0] * len(s[k : k + 9999]))], names=["component", "s", "t", "w"]) for k in range(0, len(s), 9999)]
    tracemalloc.start()
    found = list(L.detected({"iterations": 1, "max_recursion_depth": 1})(iter([head, *rest])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x for b in found for x in b["number"].to_pylist()] == list(range(n)) and peak < 60 * len(s)


def test_leiden_frames(spark):
    two = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")]
    found = {r.node: r.community for r in L.leiden(nodes(spark, *"abcxyz"), edges(spark, *two)).collect()}
    assert found["a"] == found["b"] == found["c"] != found["x"] == found["y"] == found["z"]
    assert L.leiden(nodes(spark), edges(spark)).count() == 0
    weighted = L.undirected(edges(spark, *two))
    of = spark.createDataFrame(list(found.items()), "node string, community long")
    assert L.modularity(weighted, of).head()[0] == pytest.approx(0.5)
    assert {r.density for r in L.community_density(weighted, of).collect()} == {1.0}
    assert L.warm_start(["a", "b", "c"], {"b": 7}) == [1, 0, 2]


def test_node_ids(spark):
    df = spark.createDataFrame([(i,) for i in ("", "a\\b", "./a", "a/", "/a", "a/../b", ".", "a/./b", None)], "id string")
    got = [r[0] for r in df.select(node_id_problem(F.col("id"))).collect()]
    assert got == ["empty", "backslash", "leading_dot_slash", "trailing_slash", "leading_slash", "parent_component", None, None, "empty"]


def test_unicode_words_in_classifier(spark):
    df = spark.createDataFrame([("call_expression", "z.é", "typescript")], "k string, t string, l string")
    assert df.select(classify.hint_category(F.col("k"), F.col("t"), F.col("l"))).head()[0] == "schema_validation"
    assert len(classify.CATEGORIES) == 19


@pytest.mark.parametrize("language", list(REPOS))
def test_resolution(spark, language):
    files, options = REPOS[language]
    records = spark.createDataFrame([(p, language, i) for p, i in files], "path string, language string, imports array<string>")
    assert sorted(tuple(r) for r in dependency_edges(records, **options).collect()) == sorted(EDGES[language])


def test_adapters():
    found = {lang: adapters.parse_file(*CODE[lang]) for lang in CODE}
    kinds = {lang: {h["node_kind"] for h in r["pattern_hints"]} for lang, r in found.items()}
    assert found["rust"]["imports"] == ["std::fmt"] and found["rust"]["exports"] == ["f"] and {"match_expression", "try_expression", "macro_invocation"} <= kinds["rust"]
    assert found["python"]["imports"] == ["os", "sys", ".a"] and {"try_statement", "except_clause", "list_comprehension", "call", "class_definition"} <= kinds["python"]
    assert found["typescript"]["exports"] == ["B", "f"] and {"await_expression", "arrow_function", "optional_chain", "call_expression"} <= kinds["typescript"]
    assert found["javascript"]["imports"] == ["./u"] and found["go"]["imports"] == ["fmt", "mymod/x"] and found["go"]["exports"] == ["Run"]
    assert found["java"]["imports"] == ["java.util.*", "a.B"] and {"try_statement", "throw_statement", "catch_clause", "class_declaration"} <= kinds["java"]
    assert adapters.parse_file("README.md", "x") is None


def test_jsonc_and_aliases():
    text = '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./*",], "a*b*": ["x"]}, /* d */ } }'
    assert config.parse_aliases(text) == ("", [("@/*", ["./*"])])
    assert json.loads(scalars.without_comments('{"u": "http://x", }')) == {"u": "http://x"}


def test_config_layers(tmp_path):
    (tmp_path / "user.toml").write_text('[core]\nrandom_seed = 7\n[thresholds.overrides.a]\nexpires = "2999-01-01"\n')
    (tmp_path / "project.toml").write_text('[snapshots]\nretention = 3\n[thresholds.overrides.b]\nexpires = "2000-01-01"\n')
    c = config.load_config(tmp_path, tmp_path / "user.toml", tmp_path / "project.toml", env={"DRIFTLATTICE_SNAPSHOT_DIR": "here"})
    assert c["core"]["random_seed"] == 7 and c["snapshots"] == {"dir": "here", "retention": 3} and list(c["thresholds"]["overrides"]) == ["a"]
    (tmp_path / "project.toml").write_text("[thresholds.overrides.b]\npattern_entropy_rate = 1.0\n")
    with pytest.raises(config.MissingExpires):
        config.load_config(tmp_path, tmp_path / "no.toml", tmp_path / "project.toml", env={})
    assert config.date_fault("2025-02-29") is None and config.date_fault("2025-04-31")


def test_snapshot_store(spark, tmp_path):
    base = {"graph": {"density": 0.1}, "partition": {"stability": {"0": 1.0}}, "catalog": {"entries": {}}, "pattern_metrics": {"convention_drift": 0.0, "total_entropy": 0.0, "entropy_per_category": {}, "convention_drift_per_category": {}}, "path_partition": {"a": 1}}
    for day in range(1, 6):
        snapshots.write_snapshot(tmp_path, base | {"snapshot_version": "1.0", "timestamp": f"2026-01-0{day}T00:00:00Z"}, 3)
    (tmp_path / "README.md").write_text("x")
    (tmp_path / "snapshot_99_bad.json").write_text("{")
    names = [p.name[9:24] for p in snapshots.listed(tmp_path)]
    assert names[:3] == ["20260103T000000", "20260104T000000", "20260105T000000"]
    assert len(snapshots.read_all(tmp_path)) == 3
    table = snapshots.snapshot_table(spark, str(tmp_path))
    assert table.count() == 3 and snapshots.prior_partitions(table, 2).count() == 2
    assert snapshots.category_table(table).count() == 0


def test_git_log():
    raw = b"COMMIT\0abc\x002026-01-01T00:00:00Z\0\n./a.rs\0b\\c.rs\0COMMIT\0def\x002026-01-02T00:00:00Z\0"
    assert git.parse_log(raw) == [("abc", "2026-01-01T00:00:00Z", ["a.rs", "b/c.rs"]), ("def", "2026-01-02T00:00:00Z", [])]


def test_git_logs_in_little_memory():
    """Logs of a batch are parsed some at a time: many texts, one of them null."""
    log = "".join(f"COMMIT\0{k}\x002026-01-01T00:00:00Z\0\n" + "".join(f"./f{k}{i}\0" for i in range(20)) for k in range(20))
    texts = pa.array([log, None] * 2000)
    tracemalloc.start()
    found = git.parsed_batch(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 4000 and found[1].as_py() == [] and found[3998].as_py()[19]["files"] == [f"f19{i}" for i in range(20)]
    assert peak < 4 << 20


def test_own_adapter(spark):
    from driftlattice.sources.files import routed

    def parse(path, text):
        return {"imports": [x.split()[1] for x in text.splitlines() if x.startswith("use ")], "exports": [path]}

    mine = adapters.Adapter("mine", (".my", ".go"), parse)
    rows = spark.createDataFrame([(p, bytearray(t)) for p, t in (("a.my", b"use x\nuse y"), ("b.go", b"use z"), ("c.py", b"import os"), ("d.txt", b""), ("e.my", b"\xff"))], "path string, content binary")
    got = {r.path: r for r in adapters.feature_records(rows, [mine]).collect()}
    assert {p: (r.language, r.imports) for p, r in got.items()} == {"a.my": ("mine", ["x", "y"]), "b.go": ("mine", ["z"]), "c.py": ("python", ["os"])}
    assert got["a.my"].exports == ["a.my"] and got["a.my"].pattern_hints == []
    assert {r.path: r.language for r in routed(rows, [mine]).collect()} == {"a.my": "mine", "b.go": "mine", "c.py": "python", "e.my": "mine"}
    assert {r.language for r in adapters.feature_records(rows).collect()} == {"go", "python"}


def test_history_that_cannot_be_read(spark, tmp_path):
    from driftlattice.errors import CommitError

    assert git.commits(spark, str(tmp_path)).count() == 0
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert git.commits(spark, str(tmp_path), 0).count() == 0
    with pytest.raises(CommitError):
        git.commits(spark, str(tmp_path), 5, "no-such-revision")


def test_categories_are_disjoint(spark):
    """A node kind is of one category, and a call that several patterns match has a known winner."""
    kinds = [k for ks in classify.NODE_KINDS.values() for k in ks]
    assert len(kinds) == len(set(kinds))
    calls = [("fetch(u).map(f)", "typescript"), ("JSON.parse(s)", "typescript"), ("useSelector(f)", "typescript"), ("app.get('/', h)", "typescript"), ("Promise.all(x)", "typescript"), ("requests.get(u)", "python"), ("len(x)", "python"), ("useState(0)", "javascript"), ("describe('x', f)", "typescript")]
    df = spark.createDataFrame(calls, "text string, language string")
    rows = df.select("text", classify.call_matches(F.col("text"), F.col("language")).alias("all"), classify.hint_category(F.lit("call_expression"), F.col("text"), F.col("language")).alias("one")).collect()
    assert all((r["all"][0] if r["all"] else None) == r.one for r in rows)
    overlaps = {r.text: r["all"] for r in rows if len(r["all"]) > 1}
    assert overlaps == {"fetch(u).map(f)": ["data_access", "collection_pipelines"], "useSelector(f)": ["state_store", "framework_hooks"], "app.get('/', h)": ["http_routing", "data_access"]}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from driftlattice import session

    context = SimpleNamespace(master="spark://a:7077", getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None)
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_pipeline_and_cli(spark, tmp_path, capsys):
    from driftlattice.plans import cli

    for name, text in {"a.py": "import b\n\ndef f():\n    print('x')\n", "b.py": "import c\nprint(1)\n", "c.py": "import a\nprint(2)\n", ".gitignore": "skip.py\n", "skip.py": "import a\n"}.items():
        (tmp_path / name).write_text(text)
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "conf.toml").write_text("[patterns]\nmin_pattern_nodes = 1\n")
    args = ["--repo", str(tmp_path), "--config", str(tmp_path / "conf.toml"), "--format", "json"]
    assert cli.main([*args, "snapshot"]) == 0
    first = json.loads(capsys.readouterr().out)
    assert first["graph"]["node_count"] == 3 and first["graph"]["edge_count"] == 3 and first["graph"]["cycle_count"] == 1
    assert first["catalog"]["entries"]["logging"] and first["change_coupling"]["commits_analyzed"] == 1
    (tmp_path / "d.py").write_text("import a\nimport b\n")
    assert cli.main([*args, "check"]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["boundary_violation_delta"] is None
    assert cli.main([*args, "trend"]) == 0
    assert json.loads(capsys.readouterr().out)["snapshot_count"] == 2
    assert cli.main([*args, "snapshot", "--commit", "HEAD"]) == 0
    assert len(json.loads(capsys.readouterr().out)["commit"]) == 40
    assert cli.main([*args[:-1], "text", "show"]) == 0
    assert "nodes:             " in capsys.readouterr().out
    (tmp_path / "conf.toml").write_text("[boundaries]\nleiden_max_recursion_depth = 0\n")
    assert cli.main([*args, "check"]) == 2


def test_snapshot_stream(spark, tmp_path):
    from driftlattice.streaming.snapshots import snapshot_stream

    (tmp_path / "snapshot_1.json").write_text(json.dumps({"timestamp": "t", "graph": {"density": 0.5}}))
    q = snapshot_stream(spark, str(tmp_path)).select("timestamp", "graph.density").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("seen").collect()] == [("t", 0.5)]
