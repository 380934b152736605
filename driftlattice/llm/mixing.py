"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded block selection.

1. `targets` shares the mix among the sources by weight; a source stops at `most` times its size, and what it leaves is
   shared again by weight until no source is above (water filling in closed form over the ordered cap-to-weight ratios).
2. `sainte_lague` turns targets into whole numbers of blocks by highest quotients v / (2 q + 1): first among the
   sources, then among the shards of each source by their sizes. A shard is a seeded part of a source of about
   `shard_tokens` words (more, if there were above `most_shards` shards in all), so that a source of any size is spread
   over many tasks. A block has `block` words, or a `fine`th of the smallest source, if that is less.
3. In a shard the documents, in seeded order, form one stream that is cut into blocks. A quota of q blocks out of n
   takes each block q div n times, and once more the q mod n blocks b for which (STEP b + c) mod n is smallest, where c
   is seeded; STEP is a prime above any n, so the order is a permutation.

Only DataFrame functions run. Sources are rows of one sorted window; their table is broadcast up to `SMALL` rows and
joined otherwise. Defined results: a null or empty text has size 0 and is never taken; rows with a null source form a
source that comes last in order; repeated rows are separate documents; an empty table gives no rows. Other columns pass
through; in `mix`, its own columns replace columns of the same name (without regard to case).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlattice.llm.quality import words_of
from driftlattice.llm.textbuf import checkpointed

WEIGHTS = (3, 1, 2)
STEP = (1 << 31) - 1
SMALL = 100_000


def seeded(seed: int, *parts: Column) -> Column:
    """A hex digest that is the same in every run and engine; nulls count as empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """sources(source, source_size) with rank, weight and target. One row per source: a table as small as the list of sources."""
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(ordered)
    df = sources.withColumn("rank", rank).withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1) % len(weights)))
    df = df.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "rank")
    whole = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    df = df.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(whole)["level"])
    return df.withColumn("target", F.least("cap", F.col("weight") * F.coalesce("level", F.lit(float("inf"))))).select("source", "source_size", "rank", "weight", "target")


def sainte_lague(df: DataFrame, group: list[str], key: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """df with the whole number `out` of each group's `seats` that a row gets by the highest quotients votes / (2 q + 1).

    Rounding votes / (all votes / seats) gives every row its seats but for a rest smaller than half the rows; the rest
    is settled by ranking the next (or last) quotients, of which each row offers only as many as it could win.
    """
    whole = Window.partitionBy(*group)
    v = F.col(votes).cast("double")
    df = df.withColumn("__v", F.sum(v).over(whole)).withColumn("__n", F.count(F.lit(1)).over(whole))
    df = df.withColumn("__q", F.when(F.col("__v") > 0, F.floor(v * F.col(seats) / F.col("__v") + 0.5)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("__r", F.when(F.col("__v") > 0, F.col(seats) - F.sum("__q").over(whole)).otherwise(F.lit(0)).cast("long"))
    offers = F.least(F.abs("__r"), 2 + F.ceil((F.abs("__r") + F.col("__n")) * v / F.greatest("__v", F.lit(1e-300))))
    steps = df.filter("__r != 0").withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), offers.cast("long"))))
    up = F.col("__r") > 0
    steps = steps.filter(up | (F.col("__k") < F.col("__q")))
    quotient = F.when(up, -v / (2 * (F.col("__q") + F.col("__k")) + 1)).otherwise(v / (2 * (F.col("__q") - F.col("__k")) - 1))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("__quotient", *[F.col(k).asc_nulls_last() for k in key], "__k"))
    won = steps.withColumn("__quotient", quotient).withColumn("__rank", rank).filter("__rank <= abs(__r)")
    names = list(dict.fromkeys([*[g for g in group if not g.startswith("__")], *key]))
    won = won.groupBy(*[F.col(k).alias(f"__key_{k}") for k in names]).agg(F.sum(F.signum("__r")).cast("long").alias("__won"))
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    df = df.join(won, same, "left").withColumn(out, F.col("__q") + F.coalesce("__won", F.lit(0)))
    return df.drop("__v", "__n", "__q", "__r", "__won", *[f"__key_{k}" for k in names])


OWN = ("size", "source_size", "target", "taken")


def placed(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = 64, fine: int = 16, shard_tokens: int = 250_000, most_shards: int = 100_000, seed: int = 7, weights=WEIGHTS) -> DataFrame:
    """docs(doc_id, text, source, ...) as doc_id, text, source, the columns of OWN, __row (a struct of all other columns)
    and what places a document's words in the mix: __start (place of its first word in its shard's stream), __block,
    __n, __whole, __extra, __turn (how the shard's blocks are taken)."""
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c.lower() not in ("doc_id", "text", "source")]
    docs = docs.select("doc_id", "text", "source", (F.struct(*rest) if rest else F.lit(None)).alias("__row"), F.size(words_of(F.col("text"))).cast("long").alias("size"))
    sized = checkpointed(docs.groupBy("source").agg(F.sum("size").alias("source_size")))  # a row for each source
    mixed = targets(sized, share, most, weights)
    whole = Window.partitionBy("__one")
    mixed = mixed.withColumn("__one", F.lit(0)).withColumn("__block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(whole) / fine))).cast("long"))
    mixed = mixed.withColumn("__seats", F.floor(F.sum("target").over(whole) / F.col("__block") + 0.5).cast("long"))
    tokens = F.greatest(F.lit(shard_tokens), F.ceil(F.sum("source_size").over(whole) / most_shards))
    mixed = mixed.withColumn("__tokens", tokens)
    mixed = sainte_lague(mixed, ["__one"], ["rank"], "target", "__seats", "__quota").withColumn("__n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("__tokens"))).cast("long"))
    mixed = checkpointed(mixed.select(F.col("source").alias("__source"), "source_size", "target", F.col("rank").alias("__rank"), "__block", "__quota", "__n_shards"))
    small = lambda df, n: F.broadcast(df) if n <= SMALL else df
    digest = seeded(seed, F.col("doc_id"))
    docs = docs.join(small(mixed, mixed.count()), F.col("source").eqNullSafe(F.col("__source"))).withColumn("__digest", digest)
    docs = docs.withColumn("__shard", number(F.substring("__digest", 8, 7)) % F.col("__n_shards"))
    shards = docs.groupBy("__rank", "__block", "__quota", "__shard").agg(F.sum("size").alias("__size"))
    shards = sainte_lague(shards, ["__rank"], ["__shard"], "__size", "__quota", "__own")
    filled = lambda c: F.when(F.col("__n") > 0, c).otherwise(F.lit(0)).cast("long")
    shards = shards.withColumn("__n", F.ceil(F.col("__size") / F.col("__block")).cast("long")).select(
        F.col("__rank").alias("__r"),
        F.col("__shard").alias("__s"),
        "__n",
        filled(F.floor(F.col("__own") / F.col("__n"))).alias("__whole"),
        filled(F.col("__own") % F.col("__n")).alias("__extra"),
        filled(number(seeded(seed, F.col("__rank"), F.col("__shard"))) % F.col("__n")).alias("__turn"),
    )
    shards = checkpointed(shards)
    stream = Window.partitionBy("__rank", "__shard").orderBy("__digest", "doc_id", "size")
    docs = docs.withColumn("__start", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    docs = docs.join(small(shards, shards.count()), (F.col("__rank") == F.col("__r")) & (F.col("__shard") == F.col("__s")))
    start, end, b = F.col("__start"), F.col("__start") + F.col("size"), F.col("__block")
    overlap = lambda k: F.least((k + 1) * b, end) - F.greatest(k * b, start)
    part = F.aggregate(F.sequence(F.floor(start / b), F.floor((end - 1) / b)), F.lit(0).cast("long"), lambda x, k: x + F.when(chosen(k), overlap(k)).otherwise(F.lit(0).cast("long")))
    limit = F.floor(most * F.col("size")).cast("long")
    taken = F.when(F.col("size") > 0, F.least(F.col("__whole") * F.col("size") + part, limit)).otherwise(F.lit(0).cast("long"))
    return docs.withColumn("taken", taken).select("doc_id", "text", "source", *OWN, "__row", "__start", "__block", "__n", "__whole", "__extra", "__turn")


def passed(names: list[str], **own: Column) -> list[Column]:
    """The columns `names` of a table that went through `placed`."""
    k = {c: F.col(f"__row.c{i}") for i, c in enumerate(names) if c.lower() not in ("doc_id", "text", "source")}
    return [own.get(c.lower(), k.get(c, F.col(c.lower()))).alias(c) for c in names]


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target and taken; options of `placed`."""
    names = docs.columns
    out = [c for c, n in zip(passed(names), names, strict=True) if n.lower() not in OWN]
    return placed(docs, **options).select(*out, *OWN)


def chosen(b: Column) -> Column:
    """Whether block b of a shard is taken once more."""
    return (b * STEP + F.col("__turn")) % F.col("__n") < F.col("__extra")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: whole copies of a text as often as it is taken, then one row of the words taken once more."""
    df = placed(docs, **options).filter("taken > 0")
    tokens = F.filter(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), lambda t, i: chosen(F.floor((F.col("__start") + i) / F.col("__block"))))
    rest = F.when(F.col("taken") > F.col("__whole") * F.col("size"), F.array(F.array_join(tokens, ""))).otherwise(F.array().cast("array<string>"))
    copies = F.concat(F.array_repeat(F.col("text"), F.least(F.col("__whole"), F.floor(F.col("taken") / F.greatest("size", F.lit(1)))).cast("int")), rest)
    df = df.select("doc_id", "source", "__row", F.explode(copies).alias("text"))
    return df.select(*passed(docs.columns))
