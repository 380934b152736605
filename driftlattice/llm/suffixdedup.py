"""Suffix-array dedup: bytes under a long string that also starts in a document with a smaller doc_id are removed.

Every window of `LENGTH` bytes has an anchor: the 22-byte string in it with the smallest hash (the leftmost of equals).
Equal windows have equal anchors, so only windows with a common anchor need to be compared.

1. Documents are dealt into groups g of about `group_bytes`. Each group sends the distinct hashes of its anchors, a few
   bytes for 15 bytes of text, to buckets, which return those that other documents hold too, and which of them are
   heavy: more than about `heavy` occurrences.
2. For the shared anchors each group sends its distinct contexts (the bytes of the windows that an anchor stands for)
   with the smallest doc_id that holds them; a document with a larger one is covered there without further ado.
3. A bucket keeps a logarithmic index family. Contexts come in order of doc_id, in batches; a batch gets the sorted
   array of its suffixes cut at `LENGTH` bytes, is scanned against the sorted array of each level for whole matches and
   against itself, and becomes a level; levels of equal size are merged, so each suffix is merged a logarithmic number
   of times. Suffixes are compared as bytes, hashes only bring them together.
   An anchor that stands in very many contexts (at the edge of a boilerplate passage) would bring them all to one bucket.
   Of heavy anchors the groups send each distinct window by itself, with its smallest doc_id, to a bucket by the hash of
   the whole window; those windows go through an index family of their own bucket in the same way.
4. Each group marks the covered bytes of its documents and drops them.

However many documents share a passage, each group sends it once. Groups grow with the input from `group_bytes` to
four times that, so up to 24 GB there are at most 1,024 groups and the square of that packets between groups and buckets; beyond,
packets grow with the square of the groups until there is one for each anchor. Defined results: a null text is empty; texts shorter
than `LENGTH` stay whole; rows with equal doc_id don't cover one another; a null doc_id counts as larger than any
other; an empty table gives no rows. Matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from driftlattice.llm.textbuf import bounded_batches, chunks, forget, stored

LENGTH, ANCHOR = 50, 22
OFFSETS = LENGTH - ANCHOR + 1
WIDTH = LENGTH + OFFSETS - 1
U = np.uint64
PLACE = U((1 << 28) - 1)
LAST_ID = np.iinfo(np.int64).max
CODES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = U(0x9E3779B97F4A7C15 | 1)
CHUNK = 1 << 20
COUNTS = 2.0 ** (np.maximum(np.arange(256) - 1, 0) / 8)  # what the steps of a count stand for


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place."""
    h = {1: CODES[data]}
    power = {1: STEP}
    for n in (2, 4, 8, 16):
        half = h[n // 2]
        h[n] = half[: -(n // 2)] * power[n // 2] + half[n // 2 :]
        power[n] = power[n // 2] * power[n // 2]
    n = len(data) - ANCHOR + 1
    x = h[16][:n] * power[4] * power[2] + (h[4][16 : 16 + n] * power[2] + h[2][20 : 20 + n])
    x = (x ^ (x >> U(32))) * U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U(29))


def anchors(data: np.ndarray, offs: np.ndarray):
    """row, place, hash of each anchor, and the least and the greatest distance of its windows' starts from it."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(U), none, none
    with np.errstate(over="ignore"):
        h = anchor_hashes(data)
    key = (h & ~PLACE) | np.arange(len(h), dtype=U)
    for step in (1, 2, 4, 8, OFFSETS - 16):
        key = np.minimum(key[:-step], key[step:])
    sizes = np.diff(offs)
    starts = np.flatnonzero(np.arange(len(key)) + LENGTH <= np.repeat(offs[1:], sizes)[: len(key)])  # windows inside a row
    if not len(starts):
        return none, none, none.astype(U), none, none
    at = (key[starts] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(first[1:], len(starts)) - 1
    place = at[first]
    return np.searchsorted(offs, place, side="right") - 1, place, h[place], place - starts[last], place - starts[first]


def contexts(data: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bytes of each anchor's windows, to WIDTH bytes with 0."""
    span = np.arange(WIDTH)
    at = np.minimum((place - high)[:, None] + span, len(data) - 1)
    out = data[at]
    out[span >= (high - low + LENGTH)[:, None]] = 0
    return out


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The documents of a group; its packets in the order of their bytes, so always in the same order."""
    packets = sorted(table.column("packet").to_pylist())
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(x).read_all().cast(schema) for x in packets)])


class Group:
    """The documents of one group: text, doc_id."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        self.ids = np.array(ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False), np.int64)
        self.doc_id, self.text = ids, table.column("text").combine_chunks()

    def parts(self):
        for i, j, data, offs in chunks(self.text, CHUNK):
            yield i, j, data, offs, anchors(data, offs)

    def entries(self, shared: np.ndarray, n_buckets: int):
        """(entry arrays in a fixed order; for each part the entry of each shared anchor, its row and place)."""
        found, parts = [], []
        for i, _, data, _, (row, place, h, low, high) in self.parts():
            key = (bucket_of(h, n_buckets).astype(U) << U(32)) | shortened(h).astype(U)
            k = np.searchsorted(shared, key)
            keep = shared[np.minimum(k, len(shared) - 1)] == key if len(shared) else np.zeros(len(h), bool)
            row, place, h, low, high = (x[keep] for x in (row, place, h, low, high))
            raw = np.empty((len(h), 10 + WIDTH), np.uint8)
            raw[:, :8] = h.astype(">u8").view(np.uint8).reshape(-1, 8)
            raw[:, 8], raw[:, 9] = low, high
            if len(h):
                raw[:, 10:] = contexts(data, place, low, high)
            found.append((raw.view(f"V{10 + WIDTH}").reshape(-1), self.ids[i + row]))
            parts.append((row + i, place, high))
        raw = np.concatenate([x for x, _ in found]) if found else np.zeros(0, f"V{10 + WIDTH}")
        ids = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        number: dict[bytes, int] = {}
        entry = np.fromiter((number.setdefault(x, len(number)) for x in raw.tolist()), np.int64, len(raw))
        least = np.full(len(number), LAST_ID)
        np.minimum.at(least, entry, ids)
        names = np.frombuffer(b"".join(number), np.uint8).reshape(-1, 10 + WIDTH)
        return names, least, entry, ids, parts


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(20)) % U(n)).astype(np.int64)


def shortened(h: np.ndarray) -> np.ndarray:
    """What tells anchors of one bucket apart. Two that it does not are only looked at in vain; a bucket holds as many
    anchors at any size of the input, so that stays rare."""
    return (h * STEP >> U(32)).astype(np.uint32)


def windows_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of entries: the entry of each, its place after the entry's first one, and its bytes."""
    n = raw[:, 9].astype(np.int64) - raw[:, 8] + 1
    owner = np.repeat(np.arange(len(raw)), n)
    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (10 + shift)[:, None] + np.arange(LENGTH)
    return owner, shift, np.ascontiguousarray(raw[owner[:, None], at]).view(f"S{LENGTH}").reshape(-1)


def window_hashes(windows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(windows), U)
    for column in windows.view(np.uint8).reshape(-1, LENGTH).T:
        out = (out + CODES[column]) * STEP
        out ^= out >> U(31)
    return out


class HeavyWindows:
    """The distinct windows of a group's heavy entries: bytes, smallest doc_id, bucket; `cover` tells which windows of an
    occurrence are covered."""

    def __init__(self, names: np.ndarray, least: np.ndarray, heavy: np.ndarray, n_buckets: int):
        self.number = np.cumsum(heavy) - 1  # of each entry among the heavy ones
        at = np.flatnonzero(heavy)
        owner, shift, windows = windows_of(names[at]) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, f"S{LENGTH}"))
        self.windows, self.which = np.unique(windows, return_inverse=True)
        self.least = np.full(len(self.windows), LAST_ID)
        np.minimum.at(self.least, self.which, least[at[owner]])
        self.parts = split(bucket_of(window_hashes(self.windows), n_buckets))
        self.of = np.full((len(at), OFFSETS), -1)
        self.of[owner, shift] = self.which
        self.hit = np.zeros(len(self.windows), bool)

    def cover(self, entry: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at = self.of[self.number[entry]]
        covered = (at >= 0) & (self.hit[at] | (self.least[at] < ids[:, None]))
        return (covered.astype(np.uint32) << np.arange(OFFSETS, dtype=np.uint32)).sum(1, dtype=np.uint32)


def covered_windows(windows: np.ndarray, ids: np.ndarray, batch: int = 1 << 18) -> np.ndarray:
    """Whether each window is one of a smaller doc_id too, out of an index family that takes them in order of doc_id."""
    out = np.zeros(len(ids), bool)
    order = np.argsort(ids, kind="stable")
    levels = Levels()
    for k in range(0, len(order), batch):
        rows = order[k : k + batch]
        out[rows] = levels.scan(windows[rows], ids[rows])
    return out


def split(bucket: np.ndarray):
    """(bucket, places) in order of bucket, places ascending."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[x[0]]), x) for x in np.split(order, cuts) if len(x)]


class Levels:
    """A logarithmic family of sorted suffix arrays, each with the smallest doc_id of each suffix."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def sorted_array(suffixes: np.ndarray, ids: np.ndarray):
        order = np.argsort(suffixes, kind="stable")  # merges runs that are sorted already
        suffixes, ids = suffixes[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], suffixes[1:] != suffixes[:-1]])) if len(suffixes) else np.zeros(0, np.int64)
        return suffixes[first], np.minimum.reduceat(ids, first) if len(first) else ids

    def scan(self, suffixes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each suffix is in a level, or in its own batch, with a smaller doc_id; the batch becomes a level."""
        order = np.argsort(suffixes, kind="stable")
        ordered, owners = suffixes[order], ids[order]
        own = self.sorted_array(ordered, owners)
        hit = np.zeros(len(ordered), bool)
        for level, least in [*self.levels, own]:
            at = np.minimum(np.searchsorted(level, ordered), len(level) - 1)  # both are sorted: one pass over the level
            hit |= (level[at] == ordered) & (least[at] < owners)
        covered = np.empty(len(hit), bool)
        covered[order] = hit
        self.levels.append(own)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(-2), self.levels.pop()
            self.levels.append(self.sorted_array(np.concatenate([a, b]), np.concatenate([x, y])))
        return covered


def covered_offsets(raw: np.ndarray, ids: np.ndarray, batch: int = 1 << 13) -> np.ndarray:
    """For each entry, bit k: its window k bytes after the first one is in an entry with a smaller doc_id."""
    out = np.zeros(len(ids), np.uint32)
    order = np.argsort(ids, kind="stable")
    seen: dict[bytes, int] = {}
    fresh = []
    for i, name in zip(order.tolist(), raw[order].reshape(len(order), -1).view(f"V{10 + WIDTH}").reshape(-1).tolist(), strict=True):
        known = seen.setdefault(name, int(ids[i]))
        if known < ids[i]:
            out[i] = np.uint32((1 << OFFSETS) - 1)
        else:
            fresh.append(i)
    hashes = np.ascontiguousarray(raw[fresh, :8]).view(">u8").reshape(-1)
    _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
    fresh = np.array(fresh, np.int64)[times[which] > 1]  # an anchor with one context has nothing to be compared with
    levels = Levels()
    for k in range(0, len(fresh), batch):
        rows = fresh[k : k + batch]
        owner, shift, windows = windows_of(raw[rows])
        hit = levels.scan(windows, ids[rows[owner]])
        np.bitwise_or.at(out, rows[owner[hit]], np.uint32(1) << shift[hit].astype(np.uint32))
    return out


KEEPS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
BLOBS = "kind int, bucket int, g int, a binary, b binary"


def rows_out(rows) -> pa.Table:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 2
    columns = [*zip(*rows, strict=True)] or [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "bucket", "g", "a", "b"])


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, their bytes by rank, deflated."""
    return pack(np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unpack_sorted(x: bytes) -> np.ndarray:
    planes = unpack(x, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.uint32)


def blob(table: pa.Table, kind: int) -> list[tuple[int, int, bytes, bytes]]:
    got = table.to_pydict()
    return sorted((b, g, x, y) for k, b, g, x, y in zip(got["kind"], got["bucket"], got["g"], got["a"], got["b"], strict=True) if k == kind)


def dedup(df: DataFrame, text: str = "text", group_bytes: int = 6 << 20, with_text: bool = False, heavy: int = 1 << 16, most_tasks: int = 20_000) -> DataFrame:
    """doc_id and the counts of KEEPS for every row, in any order; with_text adds the text kept, at whole characters.
    most_tasks: beyond so many groups a task takes several of them, one after the other."""
    spark = df.sparkSession
    bounded_batches(spark)
    rest = [c for c in df.columns if c.lower() not in ("doc_id", text.lower())] if with_text else []
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"__rest{k}") for k, c in enumerate(rest)])
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_groups = max(1, -(-total // max(group_bytes, min(4 * group_bytes, total // 1024))))
    tasks = max(min(n_groups, most_tasks), int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = docs.columns
    docs = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_groups)).cast("int"))
    schema = to_arrow_schema(docs.select(*columns).schema)

    def deal(batches):
        forget()
        for batch in batches:
            for b in (batch.slice(k, 4096) for k in range(0, len(batch), 4096)):
                parts = split(b.column("g").to_numpy())
                docs = b.select(columns)
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in parts], pa.int32()), pa.array([packed(docs.take(pa.array(x))) for _, x in parts], pa.binary())], names=["g", "packet"])

    def offer(key, table):
        forget()
        h, ids = [], []
        group = Group(unpacked(table, schema))
        for i, _, _, _, (row, _, hashes, _, _) in group.parts():
            h.append(hashes)
            ids.append(group.ids[i + row])
        h, ids = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((h, U), (ids, np.int64)))
        bucket, short = bucket_of(h, n_groups), shortened(h)
        order = np.lexsort((short, bucket))
        bucket, short, ids = bucket[order], short[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], (short[1:] != short[:-1]) | (bucket[1:] != bucket[:-1])])) if len(h) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, bool)
        n = np.diff(np.append(first, len(h)))
        times = np.where(several, 8 * np.log2(np.maximum(n, 1)) + 1, 0).astype(np.uint8)  # eight steps to a power of 2; 0: in one document
        short = short[first]
        return rows_out([(0, b, key[0].as_py(), pack_sorted(short[x]), pack(times[x])) for b, x in split(bucket[first])])

    def share(key, table):
        got = blob(table, 0)
        parts = [unpack_sorted(x) for _, _, x, _ in got]
        h = np.concatenate(parts)
        times = np.concatenate([unpack(y, np.uint8) for *_, y in got])
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        first = np.flatnonzero(new)
        groups = np.diff(np.append(first, len(h)))
        many = (groups > 1) | (np.maximum.reduceat(times[order], first) > 0)
        often = np.add.reduceat(COUNTS[times[order]], first) > heavy
        out, hot = np.empty(len(h), bool), np.empty(len(h), bool)
        out[order], hot[order] = np.repeat(many, groups), np.repeat(often, groups)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return rows_out([(1, b, g, pack_sorted(p[o]), pack(t[o])) for (b, g, *_), p, o, t in zip(got, parts, np.split(out, cuts), np.split(hot, cuts), strict=True) if o.any()])

    def entries(table, marks):
        """The entries of a group: names, smallest ids, entry and id of each occurrence, parts, the light entries by
        bucket, and the windows of the heavy ones."""
        got = blob(marks, 1)
        shared = np.concatenate([(np.uint64(b) << U(32)) | unpack_sorted(x).astype(U) for b, _, x, _ in got] or [np.zeros(0, U)])
        hot = np.concatenate([unpack(y, bool) for *_, y in got] or [np.zeros(0, bool)])
        order = np.argsort(shared)
        shared, hot = shared[order], hot[order]
        group = Group(table)
        names, least, entry, ids, parts = group.entries(shared, n_groups)
        h = np.ascontiguousarray(names[:, :8]).view(">u8").reshape(-1).astype(U) if len(names) else np.zeros(0, U)
        bucket = bucket_of(h, n_groups)
        heavy_entry = hot[np.searchsorted(shared, (bucket.astype(U) << U(32)) | shortened(h).astype(U))] if len(h) else np.zeros(0, bool)
        light = np.flatnonzero(~heavy_entry)
        own = {b: light[x] for b, x in split(bucket[light])}
        return group, names, least, entry, ids, parts, own, heavy_entry, HeavyWindows(names, least, heavy_entry, n_groups)

    def send(key, left, right):
        if not left.num_rows:
            return rows_out([])
        _, names, least, *_, own, _, windows = entries(unpacked(left, schema), right)
        g = key[0].as_py()
        rows = [(2, b, g, pack(names[x]), pack(least[x])) for b, x in own.items()]
        return rows_out(rows + [(4, b, g, pack(windows.windows[x]), pack(windows.least[x])) for b, x in windows.parts])

    def index(key, table):
        forget()
        rows = []
        if got := blob(table, 2):
            ids = [unpack(y, np.int64) for *_, y in got]
            raw = np.concatenate([unpack(x, np.uint8) for _, _, x, _ in got]).reshape(-1, 10 + WIDTH)
            bits = np.split(covered_offsets(raw, np.concatenate(ids)), np.cumsum([len(x) for x in ids])[:-1])
            rows += [(3, b, g, pack(x), None) for (b, g, *_), x in zip(got, bits, strict=True) if x.any()]
        if got := blob(table, 4):
            ids = [unpack(y, np.int64) for *_, y in got]
            windows = np.concatenate([unpack(x, f"S{LENGTH}") for _, _, x, _ in got])
            hits = np.split(covered_windows(windows, np.concatenate(ids)), np.cumsum([len(x) for x in ids])[:-1])
            rows += [(5, b, g, pack(x), None) for (b, g, *_), x in zip(got, hits, strict=True) if x.any()]
        return rows_out(rows)

    def remove(key, left, right):
        left = unpacked(left, schema)
        group, names, least, entry, ids, parts, own, heavy_entry, windows = entries(left, right)
        bits = np.zeros(len(names), np.uint32)
        for b, _, x, _ in blob(right, 3):
            bits[own[b]] = unpack(x, np.uint32)
        cover = np.where(ids > least[entry], np.uint32((1 << OFFSETS) - 1), bits[entry])
        if len(windows.windows):
            places = dict(windows.parts)
            for b, _, x, _ in blob(right, 5):
                windows.hit[places[b]] = unpack(x, bool)
            at = np.flatnonzero(heavy_entry[entry])
            cover[at] = windows.cover(entry[at], ids[at])
        out, done = [], 0
        for (i, j, data, offs), (row, place, high) in zip(chunks(group.text, CHUNK), parts, strict=True):
            c = cover[done : done + len(row)]
            low = names[entry[done : done + len(row)], 8].astype(np.int64) if len(row) else place
            done += len(row)
            edge = np.zeros(len(data) + 1, np.int32)
            for k in range(OFFSETS):  # the window k bytes after the first one
                at = (place - high + k)[(c >> np.uint32(k) & np.uint32(1)).astype(bool) & (k <= high - low)]
                edge += np.bincount(at, minlength=len(edge)).astype(np.int32) if len(at) else 0
                if len(at):
                    edge -= np.bincount(at + LENGTH, minlength=len(edge)).astype(np.int32)
            gone = np.cumsum(edge[:-1]) > 0
            for r, (p, q) in enumerate(zip(offs, offs[1:], strict=False)):
                x, kept = gone[p:q], data[p:q]
                n = int(np.count_nonzero(x))
                spans = int(x[0]) + int(np.count_nonzero(x[1:] & ~x[:-1])) if n else 0
                kept = (kept[~x] if n else kept).tobytes()
                out.append((i + r, q - p, n, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        at, *columns = [*zip(*out, strict=True)] or [()] * 6
        at = pa.array(at, pa.int64())
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        columns = [group.doc_id.take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))][: 6 if with_text else 5]
        columns += [left.column(f"__rest{k}").take(at) for k in range(len(rest))]
        return pa.table(columns, names=[f.name for f in out_schema.fields])

    out_schema = StructType.fromDDL(KEEPS + ", text string" * with_text)
    for k in range(len(rest)):
        out_schema.add(StructField(f"__rest{k}", docs.schema[f"__rest{k}"].dataType))
    dealt = docs.mapInArrow(deal, "g int, packet binary").repartition(tasks, "g")
    offered = dealt.groupBy("g").applyInArrow(offer, BLOBS)
    shared = stored(offered.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(share, BLOBS))
    sent = dealt.groupBy("g").cogroup(shared.repartition(tasks, "g").groupBy("g")).applyInArrow(send, BLOBS)
    found = sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(index, BLOBS)
    both = shared.union(found).repartition(tasks, "g")
    return dealt.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(remove, out_schema)


def without_repeats(df: DataFrame, **options) -> DataFrame:
    """df with the text that is left; rows of which nothing is left go, rows that were empty stay."""
    names = df.columns
    rest = [c for c in names if c.lower() not in ("doc_id", "text")]
    out = dedup(df, with_text=True, **options).filter("n_removed < n_bytes OR n_bytes = 0")
    named = {c: F.col(f"__rest{k}") for k, c in enumerate(rest)}
    return out.select(*[named.get(c, F.col(c.lower() if c.lower() in ("doc_id", "text") else c)).alias(c) for c in names])
