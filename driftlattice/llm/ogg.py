"""Media columns: an Ogg container reader and writer, and signal features of the samples read back.

The writer multiplexes two logical streams into one physical one: 8-bit unsigned samples (packets of 1,200 samples, a
granule position counts the samples up to the last packet that ends in a page) and a stream of one note (the number of
samples). Pages hold 16 segments, so packets run over page breaks. The reader verifies each page's checksum, reassembles
packets from lacing values, sorts pages into logical streams by serial number, and turns granule positions into seconds.
It raises ValueError for damaged, missing or repeated pages, for a stream without its last page or with pages after it,
for granules that go back, and for samples that are not as many as the last granule or the note says.

Defined results: a null text counts as empty; an empty text is 64 bytes 0; equal texts give equal media, as nothing but
the text enters them; repeated rows are stored one by one. Texts of any length are cut into pages; columns besides
doc_id and the text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlattice.llm.textbuf import utf8

RATE, PACKET, PAGE_SEGMENTS = 8000, 1200, 16
SAMPLES, NOTES = 0x51, 0x52  # serial numbers
FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


def crc(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04c11db7, most significant bit first, from 0): zlib's with all bits turned round."""
    x = zlib.crc32(page.translate(FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "big").translate(FLIP)[::-1], "big")


def page(lacing: bytes, body: bytes, kind: int, granule: int, serial: int, number: int) -> bytes:
    head = b"OggS" + struct.pack("<BBqIII", 0, kind, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    raw = head + body
    return raw[:22] + struct.pack("<I", crc(raw)) + raw[26:]


def pages(packets: list[bytes], granules: list[int], serial: int, number: int = 0, segments: int = PAGE_SEGMENTS, first: bool = False, last: bool = False) -> list[bytes]:
    """Packets as pages of at most `segments` lacing values; granules: the position at the end of each packet. A page in
    which no packet ends has granule -1. first, last: whether the logical stream begins or ends with them."""
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body, at, ended, out = b"".join(packets), 0, 0, []
    for k in range(0, len(lacing), segments):
        own = lacing[k : k + segments]
        n = sum(x < 255 for x in own)
        ended += n
        kind = CONTINUED * (k > 0 and lacing[k - 1] == 255) | FIRST * (first and k == 0) | LAST * (last and k + segments >= len(lacing))
        out.append(page(own, body[at : at + sum(own)], kind, granules[ended - 1] if n else -1, serial, number + len(out)))
        at += sum(own)
    return out


def write(samples: bytes) -> bytes:
    head = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, PACKET, 0)
    packets = [samples[i : i + PACKET] for i in range(0, len(samples), PACKET)]
    sound = pages(packets, [min(len(samples), (i + 1) * PACKET) for i in range(len(packets))], SAMPLES, 1, last=True)
    note = pages([str(len(samples)).encode()], [len(samples)], NOTES, 1, last=True)
    heads = pages([head], [0], SAMPLES, first=True) + pages([b"NOTE    "], [0], NOTES, first=True)
    return b"".join([*heads, *sound[:1], *note, *sound[1:]])


def read(data: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """By serial number, the packets and the granule position of each page's last one (None for the others)."""
    streams: dict[int, list[tuple[bytes, int | None]]] = {}
    partial: dict[int, list[bytes]] = {}
    numbers: dict[int, int] = {}
    latest: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or len(data) < at + 27:
            raise ValueError(f"no page at byte {at}")
        _, kind, granule, serial, number, sum_ = struct.unpack_from("<BBqIII", data, at + 4)
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if end > len(data) or len(lacing) < n:
            raise ValueError(f"the page at byte {at} is cut off")
        if crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != sum_:
            raise ValueError(f"the checksum of the page at byte {at} is wrong")
        if serial in ended:
            raise ValueError(f"stream {serial} goes on after its last page")
        if number != numbers.get(serial, -1) + 1:
            raise ValueError(f"stream {serial} lacks a page before number {number}")
        if bool(kind & FIRST) == (serial in streams) or bool(kind & CONTINUED) != (serial in partial):
            raise ValueError(f"the flags of the page at byte {at} are wrong")
        if 0 <= granule < latest.get(serial, 0):
            raise ValueError(f"the granule position of the page at byte {at} goes back")
        numbers[serial] = number
        own = streams.setdefault(serial, [])
        start, length, before = body, 0, len(own)
        for x in lacing:
            length += x
            if x < 255:
                own.append((b"".join([*partial.pop(serial, ()), data[start : start + length]]), None))
                start, length = start + length, 0
        if n and lacing[-1] == 255:
            partial.setdefault(serial, []).append(data[start : start + length])
        if (len(own) > before) != (granule >= 0):
            raise ValueError(f"the granule position of the page at byte {at} does not fit its packets")
        if granule >= 0:
            own[-1] = (own[-1][0], granule)
            latest[serial] = granule
        if kind & LAST:
            ended.add(serial)
        at = end
    if partial:
        raise ValueError("a packet is not ended")
    if ended != set(streams):
        raise ValueError("a stream lacks its last page")
    return streams


def samples_of(streams: dict) -> tuple[bytes, float]:
    """The samples and the time at which they end."""
    by_head = {packets[0][0][:8]: packets[1:] for packets in streams.values()}
    if b"PCM     " not in by_head:
        raise ValueError("no stream of samples")
    samples = b"".join(p for p, _ in by_head[b"PCM     "])
    last = next((g for _, g in reversed(by_head[b"PCM     "]) if g is not None), 0)
    if last != len(samples) or any(int(p) != len(samples) for p, _ in by_head.get(b"NOTE    ", [])):
        raise ValueError(f"{len(samples)} samples, but the last granule position is {last}")
    return samples, last / RATE


def features(samples: bytes, seconds: float) -> str:
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    mean, rms = x.mean(), np.sqrt((x * x).mean())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"seconds={seconds:.6f};mean={mean:.6f};rms={rms:.6f};crossings={crossings};peak={int(np.abs(x).max())}"


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(df: DataFrame, text: str = "text", with_media: bool = False) -> DataFrame:
    """doc_id, the columns of MEDIA, and with `with_media` the stored bytes as column media."""

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(1))
            rows = []
            for i in range(len(b)):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                media = write(padded(raw))
                back, seconds = samples_of(read(media))
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(back, seconds), media if with_media else None))
            columns = [*zip(*rows, strict=True)] or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            out = [b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))][: 9 if with_media else 8]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", *[x.split()[0] for x in MEDIA.split(", ")], "media"][: len(out)])

    return df.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id long, {MEDIA}" + ", media binary" * with_media)
