"""From a repository to a snapshot, and from snapshots to deltas, gates and trends."""

from __future__ import annotations

import datetime
import json
import logging
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlattice.errors import ConfigError, InvalidNodeId, NothingToAnalyse
from driftlattice.functions.paths import matches_any, node_id_problem
from driftlattice.operators import boundaries as B
from driftlattice.operators import community, coupling, divergence, graph, patterns
from driftlattice.operators.resolve import dependency_edges
from driftlattice.session import checkpointed
from driftlattice.sources import config as C
from driftlattice.sources import git, snapshots
from driftlattice.sources.adapters import feature_records
from driftlattice.sources.files import repository_files

log = logging.getLogger(__name__)


def validated(nodes: DataFrame) -> DataFrame:
    """nodes, or InvalidNodeId for the first one that is not valid."""
    bad = nodes.select("id", node_id_problem(F.col("id")).alias("problem")).filter("problem IS NOT NULL").orderBy("id").limit(1).collect()
    if bad:
        raise InvalidNodeId(bad[0].id, bad[0].problem)
    return nodes


def assemble_snapshot(graph_row: dict, partition: dict, catalog: dict, pattern_metrics: dict, timestamp: str, commit: str | None = None, violation_count: int | None = None, boundary_count: int = 0, change_coupling: dict | None = None, path_partition: dict | None = None) -> dict:
    """The stored form; what was not computed is left out."""
    out = {"snapshot_version": snapshots.VERSION, "timestamp": timestamp}
    if commit is not None:
        out["commit"] = commit
    out |= {"graph": graph_row, "partition": partition, "catalog": {"entries": catalog}, "pattern_metrics": pattern_metrics}
    if violation_count is not None:
        out["intent_divergence"] = {"boundary_count": boundary_count, "violation_count": violation_count}
    if path_partition:
        out["path_partition"] = path_partition
    if change_coupling is not None:
        out["change_coupling"] = change_coupling
    return out


def catalog_entries(rows) -> dict:
    entries: dict = {}
    for r in sorted(rows, key=lambda r: (r["category"], r["fingerprint"])):
        entries.setdefault(r["category"], {})[r["fingerprint"]] = {"count": r["count"], "locations": [x.asDict() for x in r["locations"]]}
    return entries


def metric_fields(rows) -> dict:
    rows = sorted(rows, key=lambda r: r["category"])
    drifts = [r["convention_drift"] for r in rows]
    return {
        "entropy_per_category": {r["category"]: r["entropy"] for r in rows},
        "total_entropy": sum((r["entropy"] for r in rows), 0.0),
        "convention_drift": sum(drifts) / len(drifts) if drifts else 0.0,
        "convention_drift_per_category": {r["category"]: r["convention_drift"] for r in rows},
    }


class Analysis:
    """A repository under a configuration."""

    def __init__(self, spark: SparkSession, root: str | Path, config: dict | None = None):
        self.spark, self.root = spark, str(root)
        self.config = config or C.load_config(root)

    def place(self, *key: str) -> Path:
        value = self.config
        for k in key:
            value = value[k]
        return Path(self.root) / value

    def records(self, root: str | None = None) -> DataFrame:
        root = root or self.root
        exclude = self.config["core"]["exclude"]
        records = checkpointed(feature_records(repository_files(self.spark, root, exclude)))
        if records.isEmpty():
            own = repository_files(self.spark, root, exclude).filter(~matches_any(F.col("path"), [".driftlattice/**"]))
            if not own.filter(F.col("path").rlike(r"(?:^|/)[^/]+\.[^./]+$")).isEmpty():
                raise NothingToAnalyse("no file is in a language that is known")
        return records

    def catalog(self, records: DataFrame | None = None) -> DataFrame:
        p = self.config["patterns"]
        return patterns.catalog(self.records() if records is None else records, p["min_pattern_nodes"], p["scope_exclude"])

    def coupling(self, revision: str = "HEAD") -> tuple[dict | None, DataFrame | None]:
        c = self.config["change_coupling"]
        commits = checkpointed(git.commits(self.spark, self.root, c["history_depth"], revision))
        if commits.isEmpty():
            return None, None
        pairs = checkpointed(coupling.change_coupling(commits, c["min_frequency"], c["history_depth"]))
        s = coupling.summary(commits, c["history_depth"]).head()
        return {"pairs": [r.asDict() for r in pairs.orderBy("source", "target").collect()], "commits_analyzed": s.commits_analyzed, "distinct_files_touched": s.distinct_files_touched}, pairs

    def snapshot(self, revision: str | None = None, timestamp: str | None = None, write: bool = True) -> dict:
        root, commit, folder = self.root, None, None
        if revision is not None:
            commit = git.resolve(self.root, revision)
            timestamp = timestamp or git.commit_time(self.root, commit)
            folder = git.extract(self.root, commit)
            root = folder.name
        timestamp = timestamp or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        b = self.config["boundaries"]
        try:
            records = self.records(root)
            nodes = records.select(F.col("path").alias("id"), "path", "language")
            aliases = C.path_aliases(root) or ("", [])
            edges = checkpointed(dependency_edges(records, go_module=C.go_module(root), aliases=aliases[1], alias_base=aliases[0]))
            cache = Path(self.root) / ".driftlattice/cache/partition.json"
            changes, pairs = self.coupling(commit or "HEAD")
            weights = coupling.coupling_weights(pairs, nodes) if b["weighted_edges"] and pairs is not None else None
            prior = snapshots.load_partition(cache)
            before = self.spark.createDataFrame(sorted(prior.items()), "node string, community long") if prior else None
            options = {"seed": self.config["core"]["random_seed"], "gamma": b["leiden_gamma"], "min_compression_ratio": b["leiden_min_compression_ratio"], "max_recursion_depth": b["leiden_max_recursion_depth"]}
            found = checkpointed(community.detect_boundaries(nodes, edges, weights, prior=before, **options))
            weighted = checkpointed(community.undirected(edges if weights is None else community.weighted_edges(edges, weights), "weight" if weights is not None else None))
            assignments = {r.node: r.community for r in found.collect()}
            density = {str(r.community): r.density for r in community.community_density(weighted, found).collect()}
            q = community.modularity(weighted, found).head().modularity
            rows = self.catalog(records).collect()
            counts = [(r["category"], r["fingerprint"], r["count"]) for r in rows]
            metrics = patterns.catalog_metrics(self.spark.createDataFrame(counts, "category string, fingerprint string, count long")).collect()
            violations, declared = None, 0
            try:
                spec = C.read_boundaries(Path(root) / b["spec_file"])
            except ConfigError as e:
                log.warning("boundaries are left out: %s", e)
                spec = None
            if spec is not None:
                declared = len(spec)
                try:
                    violations = B.boundary_violations(nodes, edges, B.spec_patterns(self.spark, spec), B.spec_allowed(self.spark, spec)).count() if spec else 0
                except ValueError as e:
                    log.warning("boundaries can't be checked: %s", e)
                    violations = 0
            top = graph.coupling_topology(nodes, edges).head()
            facts = {"node_count": top.node_count, "edge_count": top.edge_count, "density": top.density, "cycle_count": top.cycle_count, "top_hubs": [[h.path, h.out_degree] for h in top.top_hubs], "component_count": top.component_count}
            of_path = dict(sorted(assignments.items()))
            partition = {"assignments": {str(i): c for i, (_, c) in enumerate(sorted(assignments.items(), key=lambda x: x[0].split("/")))}, "stability": density, "modularity": q, "seed": self.config["core"]["random_seed"]}
            snapshot = assemble_snapshot(facts, partition, catalog_entries(rows), metric_fields(metrics), timestamp, commit, violations, declared, changes, of_path)
        finally:
            if folder is not None:
                folder.cleanup()
        if write:
            snapshots.write_snapshot(self.place("snapshots", "dir"), snapshot, self.config["snapshots"]["retention"])
            snapshots.save_partition(cache, assignments)
        return snapshot

    def check(self, write: bool = True, today: datetime.date | None = None) -> tuple[dict, list[dict], dict]:
        """(summary, breaches, applied overrides) of a new snapshot against the last one."""
        before = snapshots.latest(self.place("snapshots", "dir"))
        after = self.snapshot(write=write)
        summary = delta(before, after)
        t = self.config["thresholds"]
        return summary, *gate(self.spark, summary, t, today or datetime.date.today())

    def infer(self) -> list[dict]:
        n = self.config["boundaries"]["stability_threshold"]
        folder = str(self.place("snapshots", "dir"))
        if not snapshots.listed(folder):
            return []
        prior = snapshots.prior_partitions(snapshots.snapshot_table(self.spark, folder), n + 1)
        return [r.asDict() for r in B.infer_boundaries(prior, n).collect()]

    def ratify(self) -> tuple[Path, int, bool]:
        spec = B.ratified(self.infer())
        path = self.place("boundaries", "spec_file")
        return path, len(spec["boundaries"]), C.write_boundaries(path, spec)


def normalized_entropies(snapshot: dict) -> dict[str, float]:
    import math

    out = {}
    for category, prints in snapshot["catalog"]["entries"].items():
        counts = [x["count"] for x in prints.values() if x["count"]]
        total = sum(counts)
        h = -sum(c / total * math.log2(c / total) for c in counts) if total else 0.0
        out[category] = min(1.0, max(0.0, h / math.log2(len(counts)))) if len(counts) > 1 else 0.0
    return out


def delta(before: dict | None, after: dict) -> dict:
    """The change between two stored snapshots; all None without an earlier one."""
    names = ("pattern_entropy_delta", "convention_drift_delta", "coupling_delta", "community_count_delta", "boundary_violation_delta", "pattern_entropy_per_category_delta", "convention_drift_per_category_delta")
    if before is None:
        return dict.fromkeys(names)
    a, b = before["pattern_metrics"], after["pattern_metrics"]
    both = before.get("intent_divergence"), after.get("intent_divergence")
    change = lambda x, y: {c: y.get(c, 0.0) - x.get(c, 0.0) for c in sorted({*x, *y})}
    return dict(
        zip(
            names,
            (
                sum(normalized_entropies(after).values(), 0.0) - sum(normalized_entropies(before).values(), 0.0),
                b["convention_drift"] - a["convention_drift"],
                after["graph"]["density"] - before["graph"]["density"],
                len(after["partition"]["stability"]) - len(before["partition"]["stability"]),
                both[1]["violation_count"] - both[0]["violation_count"] if all(both) else None,
                change(a["entropy_per_category"], b["entropy_per_category"]),
                change(a.get("convention_drift_per_category") or {}, b.get("convention_drift_per_category") or {}),
            ),
            strict=True,
        )
    )


def gate(spark: SparkSession, summary: dict, thresholds: dict, today: datetime.date) -> tuple[list[dict], dict]:
    """(breaches, applied overrides) of a summary."""
    names = ("pattern_entropy_delta", "convention_drift_delta", "coupling_delta", "community_count_delta", "boundary_violation_delta")
    row = spark.createDataFrame([tuple(summary[n] for n in names)], "pattern_entropy_delta double, convention_drift_delta double, coupling_delta double, community_count_delta long, boundary_violation_delta long")
    entropy, drift = summary["pattern_entropy_per_category_delta"] or {}, summary["convention_drift_per_category_delta"] or {}
    rows = [(c, entropy.get(c), drift.get(c)) for c in sorted({*entropy, *drift})]
    per = spark.createDataFrame(rows, "category string, entropy_delta double, drift_delta double")
    rows = [(c, o.get("pattern_entropy_rate"), o.get("convention_drift_rate"), str(o["expires"])) for c, o in sorted(thresholds.get("overrides", {}).items())]
    overrides = spark.createDataFrame(rows, "category string, pattern_entropy_rate double, convention_drift_rate double, expires string")
    rates = {"pattern_entropy": thresholds["pattern_entropy_rate"], "convention_drift": thresholds["convention_drift_rate"], "coupling_delta": thresholds["coupling_delta_rate"], "boundary_violations": thresholds["boundary_violation_rate"]}
    found = [r.asDict() for r in divergence.threshold_breaches(row, per, overrides, rates, today).collect()]
    applied = {r.category: {"active": r.active, "expires": str(r.expires_on), "expired_reason": r.expired_reason} for r in divergence.applied_overrides(overrides, today).collect()}
    return found, applied


def trend(spark: SparkSession, folder: str, last_n: int | None = None) -> dict:
    table = snapshots.snapshot_table(spark, folder)
    entropy = divergence.snapshot_entropy(snapshots.category_table(table))
    series = table.select("seq", F.col("graph.density").alias("density"), F.size("partition.stability").alias("community_count"), F.col("pattern_metrics.convention_drift").alias("convention_drift"))
    series = series.join(entropy, "seq", "left").withColumn("total_entropy", F.coalesce("total_entropy", F.lit(0.0)))
    return divergence.trend(series, last_n).head().asDict()


def as_json(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)


def languages_of(root: str) -> list[str]:
    """Languages whose files are under root."""
    names = {".rs": "rust", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".mjs": "javascript", ".go": "go", ".java": "java"}
    found = set()
    for _, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and d not in ("node_modules", "target")]
        found |= {names[e] for f in files if (e := os.path.splitext(f)[1]) in names}
    return sorted(found)
