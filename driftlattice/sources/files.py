"""Files of a repository as a DataFrame."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlattice.functions.paths import extension, glob_regex, matches_any
from driftlattice.sources.adapters import Adapter, languages_by_extension


def ignore_rules(text: str, base: str = "") -> list[tuple[bool, str]]:
    """(ignored, pattern over paths) of the lines of a .gitignore in folder `base`, in order."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = glob_regex(line.lstrip("/"))[5:-2].replace(".*", "[^/]*") if "**" not in line else glob_regex(line.lstrip("/"))[5:-2]
        start = re.escape(base + "/" if base else "") + ("" if anchored else "(?:.*/)?")
        out.append((not keep, f"^{start}{body}" + ("/.*$" if folder else "(?:/.*)?$")))
    return out


def repository_files(spark: SparkSession, root: str, exclude: list[str] | None = None, respect_ignore: bool = True) -> DataFrame:
    """(path, content) of the regular files under root, hidden ones too; .gitignore counts inside git repositories."""
    # the loader's own filter leaves out names that begin with a dot, so folders are listed on the driver
    ignore = []
    names = []
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d != ".git")
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        if respect_ignore and ".gitignore" in files and os.path.isdir(os.path.join(root, ".git")):
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="ignore") as f:
                ignore += ignore_rules(f.read(), rel)
        names += [f"{rel}/{n}" if rel else n for n in sorted(files) if os.path.isfile(os.path.join(folder, n)) and not os.path.islink(os.path.join(folder, n))]
    kept = []
    for name in names:
        ignored = False
        for yes, pattern in ignore:
            if re.match(pattern, name):
                ignored = yes
        if not ignored:
            kept.append(name)
    if not kept:
        return spark.createDataFrame([], "path string, content binary")
    home = os.path.abspath(root)
    listed = spark.createDataFrame([(n,) for n in kept], "path string").filter(~matches_any(F.col("path"), exclude or []))

    def load(batches):
        for b in batches:
            rows = []
            for p in b["path"]:
                with open(os.path.join(home, p), "rb") as f:
                    rows.append(f.read())
            yield b.assign(content=rows)

    return listed.mapInPandas(load, "path string, content binary")


def stored_files(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(path, content) of files in a store that Spark reads, at any size."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split(":")[-1].lstrip("/")) + "/", "")
    return df.select(path.alias("path"), "content").filter(~matches_any(F.col("path"), exclude or []))


def routed(files: DataFrame, adapters: Iterable[Adapter] = ()) -> DataFrame:
    """files with the language of their extension; those of no known language go."""
    out = F.lit(None).cast("string")
    for ext, language in languages_by_extension(adapters).items():
        out = F.when(extension(F.col("path")) == ext, language).otherwise(out)
    return files.withColumn("language", out).filter("language IS NOT NULL")
