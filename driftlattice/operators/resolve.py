"""Import resolution: specifiers of feature records against the files of a repository.

Every rule turns a specifier into ranked lookups (kind, key); one index over the files answers all kinds with one
equi-join, and the lowest rank that is answered wins. Kinds: `path` an exact path; `stem` a file stem that only one
file has; `folder` the files of an extension directly in a folder; `below` the first Python file beneath a folder;
`subtree` a stem that only one file beneath a folder has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlattice.functions.paths import extension, order_key, parent, stem

#: Extensions tried after a path, and files tried in it as a folder.
PROBES = {
    "rust": (["rs"], ["mod.rs"]),
    "python": (["py"], ["__init__.py"]),
    "typescript": (["ts", "tsx", "d.ts"], ["index.ts", "index.tsx"]),
    "javascript": (["js", "jsx", "mjs", "cjs"], ["index.js", "index.jsx", "index.mjs", "index.cjs"]),
    "go": (["go"], []),
    "java": (["java"], []),
}
#: Folders under which Java packages are looked for, before those found in the repository.
JAVA_ROOTS = ["", "src/main/java", "src/test/java", "src", "java"]
SEP = "\x00"


def file_index(files: DataFrame) -> DataFrame:
    """(kind, key, target) of files(path)."""
    files = files.select("path").distinct()
    low = F.lower(stem(F.col("path")))
    exact = files.select(F.lit("path").alias("kind"), F.col("path").alias("key"), F.col("path").alias("target"))
    stems = files.groupBy(low.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("target")).filter("n = 1").select(F.lit("stem").alias("kind"), "key", "target")
    folders = files.select(F.lit("folder").alias("kind"), F.concat(extension(F.col("path")), F.lit(SEP), parent(F.col("path"))).alias("key"), F.col("path").alias("target"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    nested = files.select("path", F.explode(above).alias("dir"))
    below = nested.filter(extension(F.col("path")) == ".py").groupBy("dir").agg(F.min_by("path", order_key(F.col("path"))).alias("target")).select(F.lit("below").alias("kind"), F.col("dir").alias("key"), "target")
    tree = nested.groupBy(F.concat("dir", F.lit(SEP), low).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("target")).filter("n = 1").select(F.lit("subtree").alias("kind"), "key", "target")
    return exact.unionByName(stems).unionByName(folders).unionByName(below).unionByName(tree)


def java_roots(files: DataFrame) -> list[str]:
    """The fixed roots and those that paths of the repository show: a list as long as its modules."""
    found = files.select(F.explode(F.array(*[F.regexp_extract("path", f"^(.*?{s})", 1) for s in ("/src/main/java", "/src/test/java")])).alias("root")).filter("root != ''").distinct()
    return JAVA_ROOTS + sorted(r.root for r in found.collect() if r.root not in JAVA_ROOTS)


def joined(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).when(rest == "", base).otherwise(F.concat(base, F.lit("/"), rest))


def look(kind: str, key: Column, rank: int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(rank).alias("rank"))


def probes(base: Column, rest: Column, language: str, rank: int = 0) -> list[Column]:
    names, folders = PROBES[language]
    path = joined(base, rest)
    keys = [F.concat(path, F.lit(f".{e}")) for e in names] + [path] + [F.concat(path, F.lit(f"/{d}")) for d in folders]
    return [look("path", k, rank + i) for i, k in enumerate(keys)]


def climb(folder: Column, levels: Column) -> Column:
    """The folder so many levels up; null above the top."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.when(F.size(parts) >= levels, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - levels, F.lit(0))), "/"))


def lookups(path: Column, language: Column, spec: Column, go_module: str | None, roots: list[str], aliases: list[tuple[str, list[str]]], alias_base: str) -> Column:
    none = F.array().cast("array<struct<kind:string,key:string,rank:int>>")
    folder = parent(path)
    ups = F.regexp_extract(spec, r"^((?:\.\./)*)", 1)
    relative = F.when(spec.startswith("./"), F.substring(spec, F.lit(3), F.length(spec))).otherwise(F.substring(spec, F.length(ups) + 1, F.length(spec)))
    base = climb(folder, (F.length(ups) / 3).cast("int"))
    by_ext = F.when(F.lit(False), none)
    own = extension(path)
    for lang, exts in (("python", [".py"]), ("typescript", [".ts", ".tsx"]), ("javascript", [".js", ".jsx", ".mjs", ".cjs"]), ("go", [".go"]), ("java", [".java"])):
        by_ext = by_ext.when(own.isin(*exts), F.array(*probes(base, relative, lang)))
    by_ext = by_ext.otherwise(F.array(*probes(base, relative, "rust")))

    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    dotted = F.translate(F.substring(spec, dots + 1, F.length(spec)), ".", "/")
    up = climb(folder, dots - 1)
    python_relative = F.when(dotted == "", F.array(look("path", joined(up, F.lit("__init__.py")), 0))).otherwise(F.array(look("path", F.concat(joined(up, dotted), F.lit(".py")), 0), look("path", F.concat(joined(up, dotted), F.lit("/__init__.py")), 1)))
    plain = F.translate(spec, ".", "/")
    python = F.array(look("path", F.concat(plain, F.lit(".py")), 0), look("path", F.concat(plain, F.lit("/__init__.py")), 1), look("below", plain, 2))

    go = none
    if go_module is not None:
        inside = F.regexp_replace(F.substring(spec, len(go_module) + 1, 1 << 20), "^/+", "")
        go = F.when(spec.startswith(go_module) & (inside != ""), F.array(look("folder", F.concat(F.lit(f".go{SEP}"), inside), 0))).otherwise(none)

    package = F.translate(F.regexp_replace(spec, r"\.\*$", ""), ".", "/")
    java = F.when(spec.endswith(".*"), F.array(*[look("folder", F.concat(F.lit(f".java{SEP}"), joined(F.lit(r), package)), 0) for r in roots])).otherwise(F.array(*[look("path", F.concat(joined(F.lit(r), F.translate(spec, ".", "/")), F.lit(".java")), i) for i, r in enumerate(roots)]))

    alias = none
    for n, (pattern, to) in enumerate(aliases):
        pre, star, suf = pattern.partition("*")
        match = (spec.startswith(pre) & spec.endswith(suf) & (F.length(spec) >= len(pre) + len(suf))) if star else spec == pattern
        capture = F.substring(spec, F.lit(len(pre) + 1), F.length(spec) - len(pre) - len(suf)) if star else F.lit("")
        tries: list[Column] = []
        for t, target in enumerate(to):
            a, s, b = target.partition("*")
            sub = F.regexp_replace(F.concat(F.lit(a), capture, F.lit(b)) if s else F.lit(target), r"^\./", "")
            tries += probes(F.lit(alias_base), sub, "typescript", n * 10_000 + t * 100) + probes(F.lit(alias_base), sub, "javascript", n * 10_000 + t * 100 + 50)
        if tries:
            alias = F.concat(alias, F.when(match, F.array(*tries)).otherwise(none))

    first = F.lower(F.substring_index(F.regexp_replace(spec, "^(crate|self)::", ""), "::", 1))
    supers = F.regexp_extract(spec, r"^((?:super::)+)", 1)
    name = F.lower(F.substring_index(F.substring(spec, F.length(supers) + 1, F.length(spec)), "::", 1))
    top = climb(folder, (F.length(supers) / 7).cast("int"))
    rust = F.when(spec.rlike("^(crate|self)::"), F.array(look("stem", first, 0))).when(spec.startswith("super::"), F.array(look("subtree", F.concat(top, F.lit(SEP), name), 0), look("stem", name, 1))).otherwise(none)

    out = F.when(spec.startswith("./") | spec.startswith("../"), by_ext)
    out = out.when(language == "python", F.when(spec.startswith("."), python_relative).otherwise(python))
    return out.when(language == "go", go).when(language == "java", java).when(language.isin("typescript", "javascript"), alias).otherwise(rust)


def resolve_imports(records: DataFrame, go_module: str | None = None, aliases: list[tuple[str, list[str]]] | None = None, alias_base: str = "", files: DataFrame | None = None) -> DataFrame:
    """(path, import, target) of records(path, language, imports): every file that an import leads to."""
    files = records.select("path") if files is None else files
    roots = java_roots(files)
    rows = records.select("path", "language", F.explode(F.array_distinct("imports")).alias("import"))
    asked = rows.select("path", "import", F.explode(lookups(F.col("path"), F.col("language"), F.col("import"), go_module, roots, aliases or [], alias_base)).alias("l"))
    asked = asked.select("path", "import", "l.*").filter("key IS NOT NULL")
    found = asked.join(file_index(files), ["kind", "key"])
    best = found.groupBy("path", "import").agg(F.min("rank").alias("best"))
    return found.join(best, ["path", "import"]).filter("rank = best").select("path", "import", "target").distinct()


def dependency_edges(records: DataFrame, **options) -> DataFrame:
    """(source, target) of the import graph: no self-edges, no repetitions."""
    found = resolve_imports(records, **options)
    return found.select(F.col("path").alias("source"), "target").filter("source != target").distinct()
