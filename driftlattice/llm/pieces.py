"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice over a text has an edge for each vocabulary piece that the text holds. `stream` goes over the boundaries
from left to right and extends each one by the pieces that begin there. Each boundary keeps one backpointer: in a
unigram model to the start of the last piece of the best-scored path; in a BPE model to the start of the last piece of
the encoding of the text up to there. (For BPE, a sequence of pieces is an encoding just if each two neighbours,
encoded by merges on their own, stay as they are; so exactly one piece can end the encoding of each prefix, and the
merges need not be run over the text.) No later edge starts before the boundary at hand or ends more than `longest`
after it, so only that window is kept: whenever the paths from all boundaries in it meet in one, the ids up to there
are committed.

Between two characters that no piece holds side by side, all paths meet; the spans between spaces are such, so a text
is cut there, each span goes through `stream`, and the ids of short ones are kept in a bounded table for the next time.

Defined results: a null or empty text has no ids and decodes to an empty text; characters outside the vocabulary
become byte pieces (the unknown id where the model has none); decoding gives the text back exactly where there are
byte pieces, except that the mark of a space (U+2581) in a text becomes a space; round_trip decodes the ids of each text
and says whether that gave it back. Of unigram paths with equal scores the one with the longer last piece counts.
Repeated rows are encoded alike; columns besides doc_id and the text are left out, whatever their names. The model's
path is a parameter.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlattice.llm.textbuf import chunks, kept

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Spans between places that no piece of a vocabulary crosses: before spaces, or there and between Latin letters and all else.
SPANS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
FINE_SPANS = re.compile(f"{SPACE}*[{LATIN}]+|{SPACE}*[^{LATIN}{SPACE}]+|{SPACE}+")
CROSSES = re.compile(f"[{LATIN}][^{LATIN}{SPACE}]|[^{LATIN}{SPACE}][{LATIN}]")
KEPT_SPANS, KEPT_PAIRS = 200_000, 300_000  # tables are kept in two generations, so what comes often stays


class Encoder:
    def __init__(self, path: str = MODEL):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)  # only its table of pieces is used
        n = sp.get_piece_size()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_id: dict[int, int] = {}
        self.texts: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.texts.append(b"" if sp.is_control(i) else "⁇".encode())
            else:
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.texts.append(piece.replace(SPACE, " ").encode())
        self.score_of = [sp.get_score(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.floor = min(self.scores.values(), default=0.0) - 10.0  # an unknown character costs more than any piece
        self.longest = max(map(len, self.ids), default=1)
        self.unigram = any(s != int(s) for s in self.scores.values())  # merge ranks are whole numbers
        self.prefix = sp.encode("a", out_type=str)[0].startswith(SPACE) if n else True
        self.rank = {p: -s for p, s in self.scores.items() if len(p) > 1}  # the turn of the merge that makes a piece
        self.parts: dict[str, tuple[str, str]] = {}
        self.pairs: dict[int, bool] = {}
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.begins = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids  # ids, and -1 for what only begins pieces
        self.whole: dict[str, bool] = {}
        self.spans: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        split = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        fine = split and not any(map(CROSSES.search, self.ids))
        self.cut = FINE_SPANS.findall if fine else SPANS.findall if split else lambda text: [text]

    def merged(self, text: str) -> list[str]:
        """The BPE merges of a short text: the best-scored pair of neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.scores[x], -i) for i, x in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if x in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def halves(self, piece: str) -> tuple[str, str]:
        """The two parts that the last merge of a piece joins."""
        found = self.parts.get(piece)
        if found is None:
            parts = list(piece)
            while len(parts) > 2:
                best = max(((self.scores[x], -i) for i, x in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if x in self.scores), default=None)
                if best is None:
                    break
                i = -best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = self.parts[piece] = (parts[0], parts[-1])
        return found

    def follows(self, a: str, b: str) -> bool:
        """Whether the merges of a + b end in a and b: undoing the later merge of the two sides again and again, no pair
        across the border may have had an earlier turn than the merge just undone (of equals, the left one goes first)."""
        rank, limit, found = self.rank, float("inf"), True
        while True:
            across = rank.get(a + b)
            if across is not None and across < limit:
                found = False
                break
            x, y = rank.get(a, -1), rank.get(b, -1)
            if x > y:
                limit, a = x, self.halves(a)[1]
            elif y >= 0:
                limit, b = y + 1, self.halves(b)[0]
            else:
                break
        return found

    def stands(self, piece: str) -> bool:
        found = self.whole.get(piece)
        if found is None:
            found = self.whole[piece] = self.merged(piece) == [piece]
        return found

    def fits(self, before: int, k: int) -> bool:
        """Whether piece k may come after piece `before` (len(names): none) in an encoding by merges."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        fine = self.stands(self.names[k]) and (before >= len(self.names) or self.follows(self.names[before], self.names[k]))
        self.pairs[before * (len(self.names) + 1) + k] = fine
        return fine

    def stream(self, text: str):
        """Ids of a text, committed as soon as all paths in the window agree."""
        begins, pairs, longest, unigram, n = self.begins.get, self.pairs, self.longest, self.unigram, len(text)
        size = len(self.names) + 1
        free = size - 1  # no piece, or a character outside the vocabulary, which any piece may follow
        done, kept = 0, min(n, 4 * longest) + longest + 1
        back, last, total = [0] * kept, [-1] * kept, [0.0] * kept  # from boundary `done` on: length and id of the last piece
        last[0] = free
        for at in range(n):
            i = at - done
            before = last[i]
            if i + longest >= len(back):  # the paths have not met for a while
                back.append(0)
                last.append(-1)
                total.append(0.0)
            if before < 0:
                continue
            for j in range(1, min(longest, n - at) + 1):
                k = begins(text[at : at + j])
                if k is None:
                    if j > 1:
                        break
                    k = free
                elif k < 0:
                    continue
                if unigram:
                    value = total[i] + (self.score_of[k] if k != free else self.floor)
                    if last[i + j] < 0 or value > total[i + j]:
                        back[i + j], last[i + j], total[i + j] = j, k, value
                elif last[i + j] < 0:
                    good = k == free or pairs.get(before * size + k)
                    if good or good is None and self.fits(before, k):
                        back[i + j], last[i + j] = j, k
                if k == free:
                    break
            if i >= 4 * longest:  # do the paths from the boundaries in the window meet?
                met = {b for b in range(i + 1, i + longest + 1) if last[b] >= 0}
                while len(met) > 1:
                    b = max(met)
                    met.discard(b)
                    met.add(b - back[b])
                b = met.pop()
                if b > 0:
                    yield from self.path(text, done, back, last, b)
                    done += b
                    back, last, total = back[b:] + [0] * b, last[b:] + [-1] * b, total[b:] + [0.0] * b
        if last[n - done] < 0:
            raise ValueError("the lattice has no path")
        yield from self.path(text, done, back, last, n - done)

    def path(self, text: str, done: int, back: list[int], last: list[int], b: int) -> list[int]:
        """The ids from boundary `done` to the one b after it."""
        out: list[int] = []
        while b:
            k = last[b]
            if k < len(self.names):
                out.append(k)
            else:
                out += [self.bytes_id[x] for x in reversed(text[done + b - 1].encode())] if self.bytes_id else (self.unknown,)
            b -= back[b]
        out.reverse()
        return out

    def span(self, text: str) -> tuple[int, ...]:
        found = self.older.get(text)
        out = found if found is not None else tuple(self.stream(text))
        if len(text) <= 4 * self.longest:
            if len(self.spans) >= KEPT_SPANS:
                self.older = self.spans
                self.spans = {}
            self.spans[text] = out
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return list(chain.from_iterable(self.spans.get(s) or self.span(s) for s in self.cut(text)))

    def decoded(self, ids) -> bytes:
        raw = b"".join(map(self.texts.__getitem__, ids))
        return raw[1:] if self.prefix and raw[:1] == b" " else raw

    def decode(self, ids) -> str:
        return self.decoded(ids).decode("utf-8", "replace")


def encode_documents(df: DataFrame, text: str = "text", path: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, and whether decoding the ids gives the text back."""

    def run(batches):
        e = kept(("pieces", path), lambda: Encoder(path))
        for b in batches:
            for i, j, data, offs in chunks(b.column(1), 2 << 20):
                ids, sizes, same = array("i"), [0], []
                for p, q in zip(offs, offs[1:], strict=False):
                    raw = data[p:q].tobytes()
                    own = e.encode(raw.decode())
                    same.append(e.decoded(own) == raw)
                    ids.extend(own)
                    sizes.append(len(ids))
                values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(sizes), pa.int64()), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids", "round_trip"])

    return df.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode_documents(df: DataFrame, ids: str = "ids", path: str = MODEL) -> DataFrame:
    """doc_id and the text that its ids stand for; null ids count as none."""

    def run(batches):
        e = kept(("pieces", path), lambda: Encoder(path))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(F.col("doc_id").cast("long"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
