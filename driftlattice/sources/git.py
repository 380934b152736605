"""Commits out of a git repository, by its command on the driver; at scale, a table with the same columns."""

from __future__ import annotations

import os
import subprocess
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlattice.errors import CommitError

SCHEMA = "seq long, commit_sha string, commit_date string, files array<string>"
MARK = "COMMIT"
LOGS_AT_ONCE = 64
COMMITS = pa.list_(pa.struct([("commit_sha", pa.string()), ("commit_date", pa.string()), ("files", pa.list_(pa.string()))]))


def git(root: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True).stdout


def canonical(path: str) -> str:
    path = path.replace("\\", "/")
    while path.startswith("./"):
        path = path[2:]
    return path


def parse_log(raw: bytes) -> list[tuple[str, str, list[str]]]:
    """(sha, date, files) out of NUL-separated fields, in which MARK begins a commit."""
    out: list[tuple[str, str, list[str]]] = []
    fields = raw.decode("utf-8", "replace").split("\0")
    i = 0
    while i < len(fields):
        field = fields[i].strip("\n")
        if field == MARK and i + 2 < len(fields):
            out.append((fields[i + 1].strip(), fields[i + 2].strip(), []))
            i += 3
            continue
        if field and out:
            out[-1][2].append(canonical(field))
        i += 1
    return out


def parsed_texts(texts: pa.Array) -> pa.Array:
    return pa.array([[{"commit_sha": a, "commit_date": b, "files": c} for a, b, c in parse_log((t or "").encode())] for t in texts.to_pylist()], COMMITS)


def parsed_batch(texts: pa.Array) -> pa.Array:
    parsed = [parsed_texts(texts.slice(k, LOGS_AT_ONCE)) for k in range(0, len(texts), LOGS_AT_ONCE)]
    return pa.concat_arrays(parsed) if parsed else pa.array([], COMMITS)


def parsed_logs(logs: DataFrame, log: str = "log") -> DataFrame:
    """logs with the commits of each log text (as `parse_log` reads it, newest first): commit_sha, commit_date, files.

    A task has the Python objects of a few logs at a time, whatever the size of its batches; results are Arrow arrays."""

    @F.arrow_udf("array<struct<commit_sha:string,commit_date:string,files:array<string>>>")
    def parse(texts: pa.Array) -> pa.Array:
        return parsed_batch(texts)

    return logs.withColumn("commits", parse(F.col(log)))


def commits(spark: SparkSession, root: str, history_depth: int = 500, revision: str = "HEAD") -> DataFrame:
    """The last commits, oldest first by seq; none without a repository, without git or for a depth of 0. CommitError if
    git can't read the history."""
    rows: list = []
    if history_depth > 0 and os.path.exists(os.path.join(root, ".git")):
        try:
            raw = git(root, "log", "-z", "--name-only", "-n", str(history_depth), f"--format={MARK}%x00%H%x00%cI%x00", revision)
            rows = [(i, *c) for i, c in enumerate(reversed(parse_log(raw)))]
        except OSError:
            rows = []
        except subprocess.CalledProcessError as e:
            raise CommitError(f"git log {revision}: exit code {e.returncode}, {e.stderr.decode('utf-8', 'replace').strip()}") from e
    return spark.createDataFrame(rows, SCHEMA)


def resolve(root: str, revision: str) -> str:
    try:
        return git(root, "rev-parse", "--verify", f"{revision}^{{commit}}").decode().strip()
    except (OSError, subprocess.CalledProcessError) as e:
        raise CommitError(f"{revision} is not a commit") from e


def commit_time(root: str, sha: str) -> str:
    """The commit's time in UTC."""
    import datetime

    text = git(root, "show", "-s", "--format=%cI", sha).decode().strip()
    return datetime.datetime.fromisoformat(text).astimezone(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def extract(root: str, sha: str) -> tempfile.TemporaryDirectory:
    """The tree of a commit in a temporary folder of the driver; it goes when the object does."""
    folder = tempfile.TemporaryDirectory()
    try:
        archive = git(root, "archive", "--format=tar", sha)
        subprocess.run(["tar", "-x", "-C", folder.name], input=archive, check=True, capture_output=True)
    except (OSError, subprocess.CalledProcessError) as e:
        folder.cleanup()
        raise CommitError(f"the tree of {sha} can't be unpacked") from e
    return folder
