"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. `document_frequencies`: in how many documents words fall into each of `buckets` hash places, over all rows. A place
   is shared by all words that hash to it, so a relative frequency is too large by at most the mean number of distinct
   words over `buckets`, whatever the number of documents.
2. A shingle is five words in a row (all words of a shorter text); its weight is its count in the text times the mean
   inverse document frequency of its words (at least 1, so that words of all documents still count). `signatures` draws
   bands x rows consistent weighted samples (Ioffe's improved scheme): two texts share a sample with a probability of
   their weighted Jaccard similarity.
3. Equal texts form one node at once, by digest; what follows is about different texts. Texts that share a band meet in
   a bucket. First pass (`candidates`): in parts of at most about `chunk` texts, the strongest pairs that join the texts
   of a part (a maximum spanning forest by agreement of samples), so fewer links than texts however large a group is.
   They are verified on whole texts, and most copies become components at once.
4. Second pass (`crossing`): of each bucket whose texts still lie in two or more components, every part meets itself
   and every other part in a block. A task compares the samples of all pairs of a block, verifies each pair of two
   components that agrees well enough on the shingles of the whole texts, and sends only the verified links that join
   two components, so pairs are never rows. A pair that shares several bands is looked at in the first one.
5. Classes are the connected components. No pair that shares a band and agrees in `agree` of the samples is left out.

Similarity is the larger one of weighted Jaccard and Jaccard. Candidates come from weighted samples.

Defined results: a class is named by its smallest doc_id; n_links counts the links of the text that were verified on the
way to its class (not all its near copies) and is 0 for texts without near copies; null and empty texts equal each other
and nothing else, as do texts without words that are equal; repeated rows are copies; different texts under one doc_id
are nodes of their own, and give a row each; rows with a null doc_id are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlattice.llm.components import components
from driftlattice.llm.licenses import CLEAN
from driftlattice.llm.textbuf import bounded_batches, checkpointed, chunks, forget, stored

BANDS, ROWS, BUCKETS, SHINGLE = 12, 4, 1 << 17, 5
U = np.uint64
GOLDEN, ODD = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * ODD
    return x ^ (x >> U(29))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (letters and digits, A-Z as a-z) and the row it lies in."""
    clean = CLEAN[data]
    at = np.flatnonzero(clean != 32)
    if not len(at):
        return np.zeros(0, U), np.zeros(0, np.int64)
    fresh = np.empty(len(at), bool)
    fresh[0] = True
    fresh[1:] = np.diff(at) > 1
    fresh[np.searchsorted(at, offs[1:-1])[offs[1:-1] <= at[-1]]] = True  # a row's first byte begins a word
    first = np.flatnonzero(fresh)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    powers = np.cumprod(np.full(int(inside.max()) + 1, GOLDEN, U))
    sums = np.add.reduceat((clean[at].astype(U) + U(1)) * powers[inside], first)
    return mixed(sums), np.searchsorted(offs, at[first], side="right") - 1


def document_frequencies(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Inverse document frequencies by place, and the number of documents."""

    def count(batches):
        forget()
        total, rows = np.zeros(buckets, np.int64), 0
        for b in batches:
            rows += len(b)
            for _, _, data, offs in chunks(b.column(0)):
                h, row = word_hashes(data, offs)
                once = np.unique(row * buckets + (h % U(buckets)).astype(np.int64))
                total += np.bincount(once % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows), pa.int64())], names=["place", "n"])

    got = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    docs = int(n[place == -1].sum())
    counts = np.zeros(buckets)
    counts[place[place >= 0]] = n[place >= 0]
    return np.log((docs + 1) / (counts + 1)) + 1.0, docs


def shingles(data: np.ndarray, offs: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, in order of row and hash: row, hash, weight."""
    h, row = word_hashes(data, offs)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0)
    w = idf[(h % U(len(idf))).astype(np.int64)]
    first = np.searchsorted(row, np.arange(len(offs) - 1))
    counts = np.bincount(row, minlength=len(offs) - 1)
    acc, weight = np.zeros(n, U), np.zeros(n)
    length = np.minimum(SHINGLE, counts)[row]  # words in the row's shingles
    starts = np.arange(n) - first[row] + length <= counts[row]
    for k in range(SHINGLE):
        j = np.minimum(np.arange(n) + k, n - 1)
        take = k < length
        acc = np.where(take, (acc + h[j]) * GOLDEN ^ U(k + 1), acc)
        weight += np.where(take, w[j], 0)
    acc, weight, own = mixed(acc)[starts], (weight / length)[starts], row[starts]
    order = np.lexsort((acc, own))
    acc, weight, own = acc[order], weight[order], own[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(acc)))
    return own[at], acc[at], weight[at] * times


def gamma_table() -> np.ndarray:
    """Gamma(2, 1) at 2^16 evenly spaced ranks."""
    x = np.concatenate([np.geomspace(1e-7, 1, 60_000), np.linspace(1, 40, 60_000)[1:]])
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


GAMMA = gamma_table()
INVERSE, LOG = (1 / GAMMA).astype(np.float32), np.log(GAMMA).astype(np.float32)
BETA = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, n: int) -> np.ndarray:
    """n consistent weighted samples of each row that has shingles; rows without any get 0."""
    out = np.zeros((n_rows, n), U)
    if not len(h):
        return out
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sizes = np.diff(np.append(first, len(row)))
    log_w = np.log(weight).astype(np.float32)
    seeds = np.arange(1, n + 1, dtype=U) * GOLDEN
    for k in range(n):
        x = mixed(h + seeds[k])
        r = (x & U(0xFFFF)).astype(np.int32)
        beta = BETA[((x >> U(32)) & U(0xFFFF)).astype(np.int32)]
        t = np.floor(log_w * INVERSE[r] + beta)
        a = LOG[((x >> U(16)) & U(0xFFFF)).astype(np.int32)] - GAMMA[r] * (t - beta + 1)
        least = np.repeat(np.minimum.reduceat(a, first), sizes)
        at = np.flatnonzero(a == least)
        at = at[np.concatenate([[True], row[at][1:] != row[at][:-1]])]
        out[row[at], k] = mixed(h[at] + t[at].astype(np.int64).astype(U) * ODD)
    return out


def digest_of(text: Column) -> Column:
    """16 bytes that tell texts apart; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def signatures(df: DataFrame, idf: np.ndarray, n: int = BANDS * ROWS) -> DataFrame:
    """df(doc_id, digest, text) as doc_id, digest, its number of shingles, and its samples (none for a text without
    words), whole and 32 bits of each."""
    bc = df.sparkSession.sparkContext.broadcast(idf)  # 2^17 numbers at any size

    def run(batches):
        forget()
        for b in batches:
            for i, j, data, offs in chunks(b.column(2), 2 << 20):
                row, h, w = shingles(data, offs, bc.value)
                sig = samples(row, h, w, j - i, n).view(np.int64)
                sizes = np.bincount(row, minlength=j - i)
                has = sizes > 0
                ends = np.concatenate([[0], np.cumsum(has * n)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sig[has].reshape(-1), pa.int64()))
                packed = [x.tobytes() if fine else None for x, fine in zip((sig.view(U) >> U(32)).astype(np.uint32), has, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(sizes, pa.int64()), lists, pa.array(packed, pa.binary())], names=["doc_id", "digest", "n_shingles", "sig", "packed"])

    return df.select("doc_id", "digest", "text").filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, digest binary, n_shingles long, sig array<bigint>, packed binary")


def spanning(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Of texts whose samples agree `same` times, a maximum spanning forest of the pairs (i, j) with at least `least`."""
    n = len(same)
    if n == 2:
        return [(0, 1)] if same[0, 1] >= least else []
    np.fill_diagonal(same, 0)
    forest, of = [], np.arange(n)
    while True:
        outside = np.where(of[:, None] == of[None, :], 0, same)
        to = outside.argmax(1)
        value = outside[np.arange(n), to]
        joined, seen = False, set()
        for i in np.lexsort((np.arange(n), -value.astype(np.int64))).tolist():  # the strongest link of each tree to another
            if value[i] < least:
                break
            if of[i] in seen:
                continue
            seen.add(of[i])
            forest.append((i, int(to[i])))
        for i, j in forest[-len(seen) :] if seen else []:
            a, b = of[i], of[j]
            if a != b:
                of[of == max(a, b)] = min(a, b)
                joined = True
        if not joined:
            return forest


def groups(batches, keys: int):
    """Runs of rows with equal first `keys` columns, each as the lists of its other columns."""
    key, kept = None, []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if r[:keys] != key:
                if len(kept) > 1:
                    yield key, [*zip(*kept, strict=True)]
                key, kept = r[:keys], []
            kept.append(r[keys:])
    if len(kept) > 1:
        yield key, [*zip(*kept, strict=True)]


def least_of(agree: float) -> int:
    return int(np.ceil(agree * BANDS * ROWS))


def unpacked(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint32).reshape(len(packed), BANDS * ROWS)


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, band, next, n, size, x): the nodes x of nodes(node, sig, n_shingles) by band, where n > 1 share it; size sums
    up their shingles, next is a further sample. Keys are made of what `packed` holds of a sample."""
    n = BANDS * ROWS
    half = lambda k: F.shiftrightunsigned(F.get(F.col("sig"), F.lit(k)), 32)
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), *[half(b * ROWS + i) for i in range(ROWS)]).alias("key"), half((b * ROWS + ROWS + 1) % n).alias("next")) for b in range(BANDS)])
    rows = nodes.select(F.col("node").alias("x"), "n_shingles", F.explode(bands).alias("k")).select("k.band", "k.key", "k.next", "x", "n_shingles")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size")).filter("n > 1")
    return checkpointed(rows.drop("n_shingles").join(sizes, "key").select("key", "band", "next", "n", "size", "x"))


def candidates(rows: DataFrame, packed: DataFrame, agree: float, chunk: int = 1024) -> DataFrame:
    """Links (x, l) that join the texts of a part of rows: `buckets`. A bucket of more than `chunk` texts is split by a
    further sample, so that similar texts stay together, and what is still larger at random: `crossing` compares the
    parts. packed(node, packed)."""
    least = least_of(agree)
    rows = rows.withColumn("fine", F.when(F.col("n") > chunk, F.xxhash64("key", "next")).otherwise(F.col("key")))
    finer = rows.groupBy("fine").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts"))
    rows = rows.join(finer, "fine").select(F.xxhash64("fine", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("x", "band"), F.col("parts")))).alias("part"), "x")
    rows = rows.join(packed, F.col("x") == F.col("node")).select("part", "x", "packed")

    def run(batches):
        forget()
        for _, (ids, sigs) in groups(batches, 1):
            x = unpacked(sigs)
            same = np.zeros((len(ids), len(ids)), np.uint8)
            for k in range(0, len(ids), 32):
                same[k : k + 32] = (x[k : k + 32, None, :] == x[None, :, :]).sum(2)
            pairs = spanning(same, least)
            yield pa.RecordBatch.from_arrays([pa.array([f(ids[i], ids[j]) for i, j in pairs], pa.int64()) for f in (max, min)], names=["x", "l"])

    return rows.repartition("part").sortWithinPartitions("part", "x").mapInArrow(run, "x long, l long").distinct()


def agreeing(ids: np.ndarray, own: np.ndarray, comp: np.ndarray, sigs: np.ndarray, band: int, least: int, step: int = 512):
    """(first row, mask of rows by all rows) of the pairs of a block to verify: they agree in `least` samples, lie in two
    components and (in a block of two parts) two parts, and share no band before this one."""
    x = np.ascontiguousarray(sigs.T)
    two = bool((own != own[0]).any())
    for k in range(0, len(ids), step):
        mine = slice(k, k + step)
        same, before = np.zeros((len(ids[mine]), len(ids)), np.uint8), np.zeros((len(ids[mine]), len(ids)), bool)
        for b in range(BANDS):
            whole = None
            for s in x[b * ROWS : (b + 1) * ROWS]:
                equal = s[mine, None] == s[None, :]
                same += equal
                if b < band:
                    whole = equal if whole is None else whole & equal
            if whole is not None:
                before |= whole
        take = (same >= least) & (comp[mine, None] != comp[None, :]) & (ids[mine, None] > ids[None, :]) & ~before
        if two:
            take &= own[mine, None] != own[None, :]
        yield k, take


def blocks(rows: DataFrame, packed: DataFrame, of: DataFrame, chunk: int = 4096, shingles_per_part: int = 1 << 20) -> DataFrame:
    """(key, lo, hi, band, x, own, c, packed): the texts of each bucket of three and more that spans two or more
    components, in blocks of two parts. (A bucket of two has been settled by its one link.) of(node, component); texts
    without a component are their own. A part has about `chunk` texts and `shingles_per_part` shingles at most."""
    rows = rows.filter("n > 2").join(of, F.col("x") == F.col("node"), "left").select("key", "band", "n", "size", "x", F.coalesce("component", "x").alias("c"))
    apart = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    parts = F.ceil(F.greatest(F.col("n") / chunk, F.col("size") / shingles_per_part))
    rows = rows.join(apart, "key").withColumn("own", F.pmod(F.xxhash64("x"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "band", "x", "own", "c")
    return rows.join(packed, F.col("x") == F.col("node")).select("key", "lo", "hi", "band", "x", "own", "c", "packed")


def flagged(rows: DataFrame, agree: float) -> DataFrame:
    """The rows of `blocks` that have a pair to verify, out of samples alone."""
    least = least_of(agree)
    names = ["key", "lo", "hi", "band", "x", "own", "c", "packed"]

    def run(batches):
        forget()
        for key, columns in groups(batches, 4):
            ids, own, comp = (np.array(c, np.int64) for c in columns[:3])
            hit = np.zeros(len(ids), bool)
            for k, take in agreeing(ids, own, comp, unpacked(columns[3]), key[3], least):
                hit[k : k + len(take)] |= take.any(1)
                hit |= take.any(0)
            at = np.flatnonzero(hit)
            kept = [pa.array(np.full(len(at), v), pa.int64()) for v in key[:3]] + [pa.array(np.full(len(at), key[3]), pa.int32())]
            kept += [pa.array(v[at]) for v in (ids, own, comp)] + [pa.array([columns[3][i] for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(kept, names=names)

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "band", "x").mapInArrow(run, "key long, lo long, hi long, band int, x long, own long, c long, packed binary")


def crossing(rows: DataFrame, texts: DataFrame, idf: np.ndarray, agree: float, threshold: float) -> DataFrame:
    """Verified links (x, l) that join two components, out of rows: `flagged` and texts(node, text)."""
    bounded_batches(rows.sparkSession)
    bc = rows.sparkSession.sparkContext.broadcast(idf)
    least = least_of(agree)
    both = rows.join(texts, F.col("x") == F.col("node")).select("key", "lo", "hi", "band", "x", "own", "c", "packed", "text")

    def with_features(batches):
        """Texts as their shingles, a batch at a time, so that a block holds no texts."""
        for b in batches:
            hs, ws = [], []
            for i, j, data, offs in chunks(b.column(8)):
                row, h, w = shingles(data, offs, bc.value)
                cuts = np.searchsorted(row, np.arange(1, j - i))
                hs += np.split(h, cuts)
                ws += np.split(w, cuts)
            yield b, hs, ws

    def run(batches):
        forget()
        key, kept = None, []
        for b, hs, ws in with_features(batches):
            for r in zip(*[c.to_pylist() for c in b.columns[:8]], hs, ws, strict=True):
                if r[:4] != key:
                    if len(kept) > 1:
                        yield verified(key[3], *zip(*kept, strict=True))
                    key, kept = r[:4], []
                kept.append(r[4:])
        if len(kept) > 1:
            yield verified(key[3], *zip(*kept, strict=True))

    def verified(band, ids, own, comp, packed, hs, ws):
        ids, own, comp = (np.array(c, np.int64) for c in (ids, own, comp))
        links = joining(ids, own, comp, unpacked(packed), hs, ws, band, least, threshold)
        return pa.RecordBatch.from_arrays([pa.array([v[k] for v in links], pa.int64()) for k in (0, 1)], names=["x", "l"])

    return both.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "band", "x").mapInArrow(run, "x long, l long").distinct()


def joining(ids, own, comp, sigs, hs, ws, band: int, least: int, threshold: float, most: int = 1 << 21) -> list[tuple[int, int]]:
    """Of the pairs `agreeing` in a block, verified links that join what is not joined yet. hs, ws: shingles and weights
    of each text; at most about `most` shingles of partners are compared at once."""
    sizes = np.array([len(h) for h in hs])
    offs = np.concatenate([[0], np.cumsum(sizes)])
    weight = np.concatenate(ws)
    names, place = np.unique(np.concatenate(hs), return_inverse=True)
    total = np.add.reduceat(weight, offs[:-1])
    known = np.zeros(len(names))
    of, links = comp.copy(), []
    for k, take in agreeing(ids, own, comp, sigs, band, least):
        for i in np.flatnonzero(take.any(1)).tolist():
            partners = np.flatnonzero(take[i])
            i += k
            known[place[offs[i] : offs[i + 1]]] = weight[offs[i] : offs[i + 1]]
            partners = partners[of[partners] != of[i]]
            cuts = np.searchsorted(np.cumsum(sizes[partners]), np.arange(most, int(sizes[partners].sum()), most))
            for js in np.split(partners, np.unique(cuts)):
                js = js[of[js] != of[i]]
                if not len(js):
                    continue
                starts = np.cumsum(sizes[js]) - sizes[js]
                at = np.repeat(offs[js] - starts, sizes[js]) + np.arange(sizes[js].sum())
                common = known[place[at]]
                shared = np.add.reduceat(np.minimum(common, weight[at]), starts)
                n = np.add.reduceat((common > 0).astype(np.int64), starts)
                similar = np.maximum(shared / (total[i] + total[js] - shared), n / (sizes[i] + sizes[js] - n)) >= threshold - 1e-9
                for j in js[similar].tolist():
                    if of[j] != of[i]:
                        links.append((int(ids[i]), int(ids[j])))
                        of[of == max(of[i], of[j])] = min(of[i], of[j])
            known[place[offs[i] : offs[i + 1]]] = 0
    return links


def similarities(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, rows_per_key: int = 512) -> DataFrame:
    """pairs(x, l) with similarity, the larger one of weighted Jaccard and Jaccard. texts(node, text). A partner of many
    texts is spread over keys of about `rows_per_key` rows."""
    bounded_batches(pairs.sparkSession)
    bc = pairs.sparkSession.sparkContext.broadcast(idf)
    n = pairs.groupBy("l").agg(F.ceil(F.count(F.lit(1)) / rows_per_key).cast("int").alias("parts"))
    spread = pairs.join(n, "l").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")))
    one = texts.select(F.col("node").alias("x"), F.col("text").alias("tx"))
    other = n.join(texts.select(F.col("node").alias("l"), F.col("text").alias("tl")), "l").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    both = spread.join(one, "x").select("x", "l", "part", "tx").join(other.select("l", "part", "tl"), ["l", "part"]).select("x", "l", "tx", "tl")

    def run(batches):
        forget()
        kept = (None, None, None)
        for b in batches:
            ls = b.column(1).to_pylist()
            out = []
            for i, l in enumerate(ls):  # noqa: E741
                if kept[0] != l:
                    kept = (l, *features(b.column(3).slice(i, 1), bc.value))
                hx, wx = features(b.column(2).slice(i, 1), bc.value)
                _, hl, wl = kept
                at = np.minimum(np.searchsorted(hl, hx), max(len(hl) - 1, 0))
                common = hl[at] == hx if len(hl) else np.zeros(len(hx), bool)
                shared = np.minimum(wx[common], wl[at[common]]).sum()
                whole = wx.sum() + wl.sum() - shared
                n = int(np.count_nonzero(common))
                plain = n / (len(hx) + len(hl) - n) if len(hx) or len(hl) else 0.0
                out.append(max(shared / whole, plain) if whole else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["x", "l", "similarity"])

    return both.mapInArrow(run, "x long, l long, similarity double")


def features(text: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (_, _, data, offs), *_ = chunks(text, 1 << 40)
    _, h, w = shingles(data, offs, idf)
    return h, w


def classes(docs: DataFrame, threshold: float, agree: float, chunk: int) -> DataFrame:
    """docs(doc_id, digest, text) as (doc_id, digest, class_id, class_digest, n_links), a row for each text of a doc_id.
    The class is named by its smallest doc_id, and by the smallest digest under it."""
    idf, _ = document_frequencies(docs)
    signed = stored(signatures(docs, idf))
    one = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "packed")).alias("s"))
    nodes = stored(one.select(F.monotonically_increasing_id().alias("node"), "digest", "s.*"))  # a number for each text
    rows = buckets(nodes.filter(F.size("sig") > 0))
    packed = nodes.filter("packed IS NOT NULL").select("node", "packed")

    def texts_of(ids: DataFrame) -> DataFrame:
        """(node, text): only texts that have a link are read again."""
        known = nodes.select("node", "doc_id", "digest").join(ids.distinct(), "node", "left_semi")
        return stored(docs.join(known, ["doc_id", "digest"]).dropDuplicates(["node"]).select("node", "text"))

    links = checkpointed(candidates(rows, packed, agree))
    texts = texts_of(links.select(F.explode(F.array("x", "l")).alias("node")))
    good = checkpointed(similarities(links, texts, idf).filter(F.col("similarity") >= threshold - 1e-9).select("x", "l"))
    found = stored(flagged(blocks(rows, packed, components(good, "x", "l"), chunk), agree))
    if not found.isEmpty():
        more = crossing(found, texts_of(found.select(F.col("x").alias("node"))), idf, agree, threshold)
        good = checkpointed(good.union(more).distinct())
    of = components(good, "x", "l")
    counts = good.select(F.explode(F.array("x", "l")).alias("__n")).groupBy("__n").agg(F.count(F.lit(1)).alias("n_links"))
    known = nodes.select("node", "digest", "doc_id").join(of.withColumnRenamed("node", "__of"), F.col("node") == F.col("__of"), "left")
    known = known.join(counts, F.col("node") == F.col("__n"), "left").select(F.coalesce("component", "node").alias("component"), "digest", "doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    heads = known.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("head"))
    known = known.join(heads, "component").select("digest", F.col("head.doc_id").alias("class_id"), F.col("head.digest").alias("class_digest"), "n_links")
    return signed.select("doc_id", "digest").distinct().join(known, "digest").select("doc_id", "digest", "class_id", "class_digest", "n_links")


def near_duplicates(df: DataFrame, text: str = "text", threshold: float = 0.8, agree: float = 0.62, chunk: int = 4096) -> DataFrame:
    """doc_id, class_id, n_links of every document. agree: share of samples that must agree before texts are compared;
    it lies three standard errors below the threshold. chunk: texts that a task compares with as many others at once;
    classes don't depend on it."""
    content = F.col(text).cast("string")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(content).alias("digest"), content.alias("text"))
    return classes(docs, threshold, agree, chunk).select("doc_id", "class_id", "n_links")


def one_of_each(df: DataFrame, text: str = "text", threshold: float = 0.8, agree: float = 0.62, chunk: int = 4096) -> DataFrame:
    """df without near copies: of each class the text with the smallest doc_id. Rows with a null doc_id all stay."""
    content = F.col(text).cast("string")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(content).alias("digest"), content.alias("text"))
    heads = classes(docs, threshold, agree, chunk).filter("doc_id = class_id AND digest = class_digest").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__head")).distinct()
    own = df.withColumn("__digest", digest_of(content))
    kept = own.join(heads, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__digest") == F.col("__head")), "left_semi").dropDuplicates(["doc_id", "__digest"])
    return kept.drop("__digest").union(df.filter("doc_id IS NULL"))
