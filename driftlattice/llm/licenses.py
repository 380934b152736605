"""License scans: a fuzzy search for short notices.

A text is taken as its words (letters and digits, A-Z in lower case) with one space between them. Each notice allows
up to k edits (k grows with its length). Pigeonhole: cut into k + 1 pieces, at least one piece of a match is whole, so
an Aho-Corasick pass over the pieces finds every candidate place. Around each, the regex library's bounded-error
matching verifies the edits and reports the span. Words that tell one license from another (in capitals below) must
stand in it with hardly an edit: one for five characters, so `mit` with none. The base phrases are notices with k = 0:
their one piece is the whole phrase, and each place where their words stand is counted.

Defined results: null and empty texts have no words, no matches and score 0; repeated rows are scanned one by one;
spans are word numbers from 0; of overlapping matches of one notice the first best one counts. Texts are scanned whole,
a few MB at a time. Columns besides doc_id and the text are left out, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlattice.llm.textbuf import chunks

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that the fuzzy search knows: label and words. Words in capitals must be there.
NOTICES = (
    ("agpl", "gnu AFFERO general public license"),
    ("apache", "licensed under the APACHE license version"),
    ("bsd", "REDISTRIBUTION and use in source and BINARY forms"),
    ("bsd", "released under the BSD license"),
    ("cc-by", "CREATIVE COMMONS ATTRIBUTION"),
    ("gpl", "GNU GENERAL public license"),
    ("gpl", "released under the GPL license"),
    ("isc", "released under the ISC license"),
    ("lgpl", "gnu LESSER general public license"),
    ("mit", "released under the MIT license"),
    ("mit", "PERMISSION is hereby GRANTED free of charge to any person"),
    ("mpl", "MOZILLA public license"),
    ("reserved", "all RIGHTS RESERVED"),
    ("unlicense", "released into the PUBLIC DOMAIN"),
)
#: One edit is allowed for so many characters of a notice.
CHARACTERS_PER_EDIT = 10
#: The same for the words that must be there.
CHARACTERS_PER_EDIT_IN_KEY = 5

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
CLEAN = np.full(256, 32, np.uint8)  # what is not a word becomes a space
CLEAN[WORD] = np.arange(256)[WORD]
CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD[0x41:0x5B] = True


def normalized(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with one space after each, rows apart by a line feed; the rows' offsets in it and their numbers of words."""
    clean = CLEAN[data]
    is_word = clean != 32
    ends = np.empty(len(data), bool)  # the last byte of a word
    if len(data):
        ends[:-1] = is_word[:-1] & ~is_word[1:]
        ends[-1] = is_word[-1]
    last = offs[1:][offs[1:] > offs[:-1]] - 1
    ends[last] |= is_word[last]
    row_words = np.diff(np.concatenate([[0], np.cumsum(ends)])[offs])
    row_bytes = np.diff(np.concatenate([[0], np.cumsum(is_word)])[offs])
    sizes = row_bytes + row_words + 1  # a line feed stands before each row
    out_offs = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(out_offs[-1], 32, np.uint8)
    out[out_offs[:-1]] = 10
    at = np.flatnonzero(is_word)
    before = np.cumsum(ends) - ends  # words ended before each byte
    shift = np.repeat(np.arange(1, len(offs)), np.diff(offs))[at]
    out[np.arange(len(at)) + before[at] + shift] = clean[at]
    return out, out_offs, row_words


@lru_cache(1)
def plan():
    """The automaton over the pieces; for each piece its notices; the notices: label, words, edits, pattern, patterns of
    the words that must be there."""
    notices = [(label, text, 0, None, []) for text, label in BASE.items()]
    for label, text in NOTICES:
        k = max(1, len(text) // CHARACTERS_PER_EDIT)
        keys = [regex.compile(f"(?<![^ ])(?:{w.lower()}){{e<={len(w) // CHARACTERS_PER_EDIT_IN_KEY}}}(?![^ ])") for w in text.split() if w.isupper()]
        text = text.lower()
        notices.append((label, text, k, regex.compile(f"(?b)(?<= )(?:{regex.escape(text)}){{e<={k}}}(?= )"), keys))
    pieces = defaultdict(list)
    for n, (_, text, k, *_) in enumerate(notices):
        if k == 0:
            pieces[f" {text} "].append((n, 1))
            continue
        cuts = np.linspace(0, len(text), k + 2).astype(int)
        for a, b in zip(cuts, cuts[1:], strict=False):
            pieces[text[a:b]].append((n, a))
    auto = ahocorasick.Automaton()
    for piece, uses in pieces.items():
        auto.add_word(piece, (len(piece), uses))
    auto.make_automaton()
    return auto, notices


def scan(data: np.ndarray, offs: np.ndarray):
    """For each row: number of words, and its matches as (label, first word, last word, edits, length, base)."""
    text, starts, n_words = normalized(data, offs)
    plain = text.tobytes().decode("latin-1").replace("\n", "\n ")  # a space on both sides of every word
    starts = starts + np.arange(len(starts))
    auto, notices = plan()
    found: list[list] = [[] for _ in range(len(offs) - 1)]
    candidates = defaultdict(list)
    for end, (length, uses) in auto.iter(plain):
        for n, offset in uses:
            candidates[n].append(end - length + 1 - (offset if notices[n][3] else -1))
    words_at = lambda row, at: plain.count(" ", starts[row] + 2, at)
    for n, places in candidates.items():
        label, notice, k, pattern, keys = notices[n]
        rows = np.searchsorted(starts, places, side="right") - 1
        if pattern is None:
            for row, at in zip(rows.tolist(), places, strict=True):
                first = words_at(row, at)
                found[row].append((label, first, first + notice.count(" "), 0, len(notice), True))
            continue
        done = (-1, -1)
        for at in sorted(set(places)):
            row = int(np.searchsorted(starts, at + k, side="right")) - 1
            row = max(row, 0)
            low, high = max(starts[row] + 1, at - k - 1), min(starts[row + 1] if row + 1 < len(starts) else len(plain), at + len(notice) + k + 1)
            low = max(low, done[1] - 1) if done[0] == row else low
            m = pattern.search(plain, low, high) if high - low > len(notice) - k else None
            if m and all(key.search(m.group()) for key in keys):
                first = words_at(row, m.start())
                found[row].append((label, first, first + m.group().strip().count(" "), sum(m.fuzzy_counts), len(notice), False))
                done = (row, m.end())
    return n_words, found


def license_scan(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the digest columns, and the matches with their spans."""
    match = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            for i, j, data, offs in chunks(b.column(1)):
                n_words, found = scan(data, offs)
                rows = []
                for n, matches in zip(n_words.tolist(), found, strict=True):
                    base = [m for m in matches if m[5]]
                    score = max((1.0 - m[3] / m[4] for m in matches), default=0.0)
                    rows.append((n, len(base), min((m[1] for m in base), default=None), max((m[1] for m in base), default=None), ",".join(sorted({m[0] for m in base})), ",".join(sorted({m[0] for m in matches})), score, [dict(zip(("label", "first_word", "last_word", "edits", "base"), (*m[:4], m[5]), strict=True)) for m in sorted(matches)]))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match]
                columns = [pa.array(c, k) for c, k in zip([*zip(*rows, strict=True)], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,last_word:long,edits:int,base:boolean>>"
    return df.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
