"""The snapshot store: one JSON file for each snapshot, names in order of time."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlattice.errors import SnapshotError
from driftlattice.functions.fingerprint import blake3

VERSION = "1.0"
SCHEMA = (
    "snapshot_version string, timestamp string, commit string, "
    "graph struct<node_count:bigint,edge_count:bigint,density:double,cycle_count:bigint,top_hubs:array<string>,component_count:bigint>, "
    "partition struct<assignments:map<string,bigint>,stability:map<string,double>,modularity:double,seed:bigint>, "
    "catalog struct<entries:map<string,map<string,struct<count:bigint,locations:array<struct<file:string,start_row:bigint,start_col:bigint>>>>>>, "
    "pattern_metrics struct<entropy_per_category:map<string,double>,total_entropy:double,convention_drift:double,convention_drift_per_category:map<string,double>>, "
    "intent_divergence struct<boundary_count:bigint,violation_count:bigint>, path_partition map<string,int>, "
    "change_coupling struct<pairs:array<struct<source:string,target:string,frequency:double,cochange_count:int>>,commits_analyzed:int,distinct_files_touched:int>, "
    "_corrupt_record string"
)


def file_name(timestamp: str, body: bytes) -> str:
    return f"snapshot_{timestamp.translate(str.maketrans('', '', '-:Z'))}_{blake3(body).hex()[:8]}.json"


def replace(path: Path, body: bytes) -> None:
    """Writes a file in one step."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.part")
    part.write_bytes(body)
    os.replace(part, path)


def write_snapshot(folder: str | Path, snapshot: dict, retention: int = 0) -> Path:
    body = json.dumps(snapshot, indent=2, ensure_ascii=False).encode()
    path = Path(folder) / file_name(snapshot["timestamp"], body)
    replace(path, body)
    enforce_retention(folder, retention)
    return path


def write_snapshots(rows: DataFrame, folder: str) -> int:
    """Writes each row of `rows` (columns of SCHEMA) as a snapshot, from the tasks; folder is on a shared file system. The
    number of files; a task that runs twice writes the same ones."""

    def run(batches):
        for b in batches:
            for time, text in zip(b["timestamp"], b["body"], strict=True):
                body = text.encode()
                replace(Path(folder) / file_name(time, body), body)
            yield b[["timestamp"]]

    body = F.to_json(F.struct(*rows.columns), {"pretty": "true"})
    return rows.select("timestamp", body.alias("body")).mapInPandas(run, "timestamp string").count()


def listed(folder: str | Path) -> list[Path]:
    return sorted(Path(folder).glob("snapshot_*.json")) if Path(folder).is_dir() else []


def enforce_retention(folder: str | Path, most: int) -> list[Path]:
    """Deletes all but the newest `most` snapshots; 0 keeps all."""
    gone = listed(folder)[:-most] if most > 0 else []
    for path in gone:
        path.unlink()
    return gone


def retention_plan(names: DataFrame, most: int) -> DataFrame:
    """(name, kept) of a listing of names: the newest `most` snapshots stay; other files are not touched."""
    own = names.filter(F.col("name").rlike(r"^snapshot_.*\.json$"))
    rank = F.row_number().over(Window.orderBy(F.desc("name")))  # a row for each file of one folder
    return own.select("name", ((F.lit(most) == 0) | (rank <= most)).alias("kept"))


def load(path: str | Path) -> dict:
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise SnapshotError(f"{path}: {e}") from e
    if not isinstance(found, dict) or "graph" not in found:
        raise SnapshotError(f"{path}: not a snapshot")
    return found


def read_all(folder: str | Path) -> list[dict]:
    """Snapshots in order of time; those that can't be read are left out."""
    out = []
    for path in listed(folder):
        try:
            out.append(load(path))
        except SnapshotError:
            continue
    return out


def latest(folder: str | Path) -> dict | None:
    paths = listed(folder)
    return load(paths[-1]) if paths else None


def by_id(folder: str | Path, name: str) -> dict:
    return load(Path(folder) / (name if name.endswith(".json") else f"{name}.json"))


def snapshot_table(spark: SparkSession, folder: str) -> DataFrame:
    """The store as a table, with seq in order of file name; malformed files are left out."""
    df = spark.read.schema(SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{folder}/snapshot_*.json")
    df = df.withColumn("file_name", F.col("_metadata.file_name")).filter("_corrupt_record IS NULL AND graph IS NOT NULL").drop("_corrupt_record")
    return df.withColumn("seq", F.row_number().over(Window.orderBy("file_name")))  # a row for each snapshot


def prior_partitions(snapshots: DataFrame, n: int) -> DataFrame:
    """(snapshot_idx, node, community) of the last n snapshots."""
    last = snapshots.select("seq", "path_partition").orderBy(F.desc("seq")).limit(n) if n > 0 else snapshots.select("seq", "path_partition").limit(0)
    return last.select(F.col("seq").alias("snapshot_idx"), F.explode("path_partition").alias("node", "community"))


def category_table(snapshots: DataFrame) -> DataFrame:
    """(seq, category, entropy, convention_drift): entropy anew from the catalogs, drift as it is stored."""
    from driftlattice.operators.patterns import category_metrics

    flat = snapshots.select("seq", F.explode("catalog.entries").alias("category", "prints")).select("seq", "category", F.explode("prints").alias("fingerprint", "s"))
    counts = flat.select(F.struct("seq", "category").alias("category"), "fingerprint", F.col("s.count").alias("count"))
    entropy = category_metrics(counts).select("category.seq", "category.category", F.col("entropy_normalized").alias("entropy"))
    drift = snapshots.select("seq", F.explode("pattern_metrics.convention_drift_per_category").alias("category", "convention_drift"))
    return entropy.join(drift, ["seq", "category"], "full_outer").select("seq", "category", F.coalesce("entropy", F.lit(0.0)).alias("entropy"), F.coalesce("convention_drift", F.lit(0.0)).alias("convention_drift"))


def load_partition(path: str | Path) -> dict[str, int] | None:
    """A cached partition by path; None if it is missing or damaged."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
        return {str(k): int(v) for k, v in found["assignments"].items()}
    except (OSError, ValueError, KeyError, AttributeError, TypeError):
        return None


def save_partition(path: str | Path, assignments: dict[str, int]) -> None:
    replace(Path(path), json.dumps({"assignments": assignments}, sort_keys=True).encode())
