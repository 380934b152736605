"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. `character_model`: counts of character triples in the words of every text (a-z, a border, all else), and of look-alike
   characters between two letters. `channel` learns from the latter what a look-alike costs as each letter that it may
   stand for, by expectation maximization under the character model.
2. Words that may be disguised (a look-alike character beside letters or at the end, look-alikes alone unless they are a
   number, a letter three times in a row, four letters and more spaced out one by one) are decoded: each observed character opens the letters it may stand for, a repeated one may stand
   for nothing, spaced letters may hold word borders; Viterbi finds the cheapest reading under the character model.
   Other words have one reading only, themselves, so to skip them changes nothing.
3. `fit` learns a word list from labelled rows: whole words and word starts that toxic texts hold and clean ones do
   not, picked one after the other so that each explains toxic texts of which the earlier ones explain too little (a cover
   of `cover` features a text), if chance cannot explain their counts. The score of a text is a logistic function of the summed evidence of its
   distinct restored words, and of a weaker part that ranks texts but cannot reach the threshold by itself: the mean
   log-odds of its words' hash places, with counts from the same labelled rows.

It learns from a bounded, seeded sample of labelled rows: about `n_toxic` and `n_clean` of those whose texts have at most
`most_bytes` bytes; the character model and the channel cover all rows. A doc_id that is labelled both ways is left out.
Defined results: null and empty texts have no evidence, so the lowest score; repeated rows score alike; with no
labelled rows every text has the same score, below 0.5. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from driftlattice.llm.textbuf import chunks, forget, kept

BORDER, OTHER, N = 0, 27, 28
CODE = np.full(256, BORDER, np.int64)
CODE[0x41:0x5B] = CODE[0x61:0x7B] = np.arange(1, 27)
CODE[0x80:] = OTHER
#: What a character may stand for besides itself.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
TAIL = "!$|+"  # look-alikes that may also be punctuation at a word's end
EDGE = ".,;:?\"'()[]{}<>%&#*-_=~^`/\\…«»¿¡"
SUSPECT = re.compile(r"^[0-9@$!|+€]*[@$!|+€][0-9@$!|+€]*$|[^\W\d_][0-9@$!|+€]|[0-9@$!|+€][^\W\d_]|([^\W\d_])\1\1")  # numbers stay numbers
REPEAT, BREAK = 1.5, 4.0  # costs, in nats
PREFIXES = (4, 5, 6)
KEPT_WORDS, RANKS = 200_000, 1 << 16
LOOK_BYTES = [c for c in LOOKS if c.isascii()]
LOOK_CODE = np.zeros(256, np.uint8)
LOOK_CODE[[ord(c) for c in LOOK_BYTES]] = np.arange(1, len(LOOK_BYTES) + 1)


def character_model(df: DataFrame, text: str = "text") -> tuple[np.ndarray, dict[str, dict[str, float]]]:
    """Costs [before][last][next] of characters, and the costs of `channel`, from all texts; tasks send sums, at most
    28^3 of triples and as many of look-alikes for each of their kinds."""

    def count(batches):
        forget()
        total = np.zeros((len(LOOK_BYTES) + 1) * N**3, np.int64)
        for b in batches:
            for _, _, data, offs in chunks(b.column(0)):
                codes = CODE[data]
                c = np.insert(codes, offs[:-1], BORDER)  # texts are apart
                if len(c) > 2:
                    total[: N**3] += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3)
                looks = LOOK_CODE[data]
                edge = np.zeros(len(data) + 1, bool)
                edge[offs] = True
                at = np.flatnonzero(looks)
                at = at[~edge[at] & ~edge[at + 1]]
                at = at[(codes[at - 1] > 0) & (codes[at + 1] > 0)]
                total += np.bincount(looks[at].astype(np.int64) * N**3 + codes[at - 1] * N + codes[at + 1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["triple", "n"])

    counts = np.zeros((len(LOOK_BYTES) + 1) * N**3)
    got = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column(0).to_numpy()] = got.column(1).to_numpy()
    looks = counts[N**3 :].reshape(len(LOOK_BYTES), N, N, N)[:, 0]
    counts = counts[: N**3].reshape(N, N, N)
    two = counts.sum(0)
    one = two.sum(0)
    p1 = (one + 1) / (one + 1).sum()
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    return -np.log((counts + 20 * p2) / (counts.sum(2, keepdims=True) + 20)), channel(looks, p2)


def channel(looks: np.ndarray, p2: np.ndarray, rounds: int = 20) -> dict[str, dict[str, float]]:
    """The cost of each look-alike as a letter, -log P(look-alike | letter, disguised). looks[c][a][b]: how often c stands
    between the letters a and b. Each round shares every count among the letters c may stand for, by how well they fit
    between a and b and by the costs so far; letters start with equal chances for their look-alikes."""
    kinds = {c: [code(x) for x in LOOKS[c]] for c in LOOK_BYTES}
    n_of = Counter(x for xs in kinds.values() for x in xs)
    p = {(c, x): 1.0 / n_of[x] for c, xs in kinds.items() for x in xs}
    for _ in range(rounds):
        n = {}
        for k, (c, xs) in enumerate(kinds.items()):
            fit_ = np.array([p2[:, x][:, None] * p2[x][None, :] * p[c, x] for x in xs])
            n |= {(c, x): float((looks[k] * share).sum()) for x, share in zip(xs, fit_ / fit_.sum(0), strict=True)}
        of = Counter()
        for (_, x), m in n.items():
            of[x] += m
        p = {(c, x): (m + 1) / (of[x] + n_of[x]) for (c, x), m in n.items()}
    out = {c: {chr(96 + x): -math.log(p[c, x]) for x in xs} for c, xs in kinds.items()}
    return out | {c: dict.fromkeys(LOOKS[c], 1.0) for c in LOOKS if c not in out}


def code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else BORDER


def restorations(observed: str, cost: list, looks: dict[str, dict[str, float]], least: int, spaced: bool = False) -> list[str]:
    """The cheapest readings of the first `least`, `least` + 1, ... and of all characters under the character model."""
    out = []
    paths = {(BORDER, BORDER, ""): (0.0, "")}  # last two codes and the last letter -> cost, reading
    for i, seen in enumerate(observed):
        after: dict = {}
        drawn = seen * 3 in observed[max(0, i - 2) : i + 3]  # only three or more of a character may stand for fewer
        options = [(seen, 0.0)] if seen.isalpha() else []
        options += looks.get(seen, {}).items()
        if not options:
            options = [(seen, 0.0)]
        for (a, b, letter), (total, reading) in paths.items():
            for c, extra in options:
                k = code(c)
                new = [((b, k, c), total + extra + cost[a][b][k], reading + c)]
                if c == letter and drawn:
                    new.append(((a, b, letter), total + extra + REPEAT, reading))
                if spaced and reading:
                    new.append(((BORDER, k, c), total + extra + BREAK + cost[a][b][BORDER] + cost[b][BORDER][k], reading + " " + c))
                for key, value, text in new:
                    if key not in after or value < after[key][0]:
                        after[key] = (value, text)
        paths = after
        if i + 1 >= least:
            out.append(min((total + cost[a][b][BORDER], reading) for (a, b, _), (total, reading) in paths.items())[1])
    return out


def restore(observed: str, cost: list, looks: dict[str, dict[str, float]], spaced: bool = False) -> str:
    """The cheapest reading of a word (or of letters spaced out) under the character model."""
    return restorations(observed, cost, looks, len(observed), spaced)[0] if observed else ""


def spaced_runs(text: str) -> list[str]:
    """Letters (or look-alikes) that stand alone, four or more in a row, joined."""
    out, run = [], []
    for w in re.split(r"[\s._\-*]+", text):
        w = w.strip(EDGE)
        w = w.rstrip(TAIL) or w  # 't!' is a 't'
        if len(w) == 1 and (w.isalpha() or w in LOOKS):
            run.append(w)
            continue
        if len(run) > 3:
            out.append("".join(run))
        run = []
    if len(run) > 3:
        out.append("".join(run))
    return out


class Restorer:
    """Distinct restored words of a text, with a bounded table of tokens seen before; only words with evidence under
    `weights`, if they are given. model: what `character_model` gives."""

    def __init__(self, model, weights: dict[str, float] | None = None, odds: np.ndarray | None = None):
        self.cost, self.looks, self.weights, self.odds = model[0].tolist(), model[1], weights, odds
        self.seen: dict[str, tuple[str, ...]] = {}
        self.odd: dict[str, float] = {}  # the same tokens' log-odds

    def readings(self, token: str) -> tuple[str, ...]:
        whole = token.lower().rstrip(EDGE + TAIL).lstrip(EDGE)
        words = re.findall(r"[^\W\d_]+", whole)
        if SUSPECT.search(whole):
            words += re.findall(r"[^\W\d_]+", restore(whole, self.cost, self.looks))
        full = token.lower().strip(EDGE)
        if len(full) > len(whole):  # any part of the tail may belong to the word
            for reading in restorations(full, self.cost, self.looks, len(whole) + 1):
                words += re.findall(r"[^\W\d_]+", reading)
        found = tuple(dict.fromkeys(words if self.weights is None else (w for w in words if any(f in self.weights for f in features(w)))))
        if len(self.seen) >= KEPT_WORDS:
            self.seen.clear()
            self.odd.clear()
        self.seen[token] = found
        return found

    def in_order(self, text: str, spaced: bool) -> dict[str, str]:
        """The distinct restored words, each with the token before its first place."""
        out: dict[str, str] = {}
        before = ""
        for token in text.split():
            found = self.seen.get(token)
            for w in self.readings(token) if found is None else found:
                out.setdefault(w, before)
            before = token
        for w in self.words(text, spaced) if spaced else ():
            out.setdefault(w, "")
        return out

    def mean_odds(self, tokens: set[str]) -> float:
        """The mean log-odds of distinct tokens, between -1 and 1; -1 without any."""
        try:
            return math.tanh(sum(map(self.odd.__getitem__, tokens)) / len(tokens))
        except KeyError:
            if len(self.odd) >= KEPT_WORDS:
                self.odd.clear()
            self.odd |= {x: float(self.odds[rank_of(x)]) for x in tokens if x not in self.odd}
            return math.tanh(sum(map(self.odd.__getitem__, tokens)) / len(tokens))
        except ZeroDivisionError:
            return -1.0

    def words(self, text: str, spaced: bool, tokens: set[str] | None = None) -> set[str]:
        """The distinct restored words of a text; tokens: its distinct tokens, where they are at hand."""
        out: set[str] = set()
        get = self.seen.get
        for token in set(text.split()) if tokens is None else tokens:
            found = get(token)
            if found is None:
                found = self.readings(token)
            if found:
                out.update(found)
        if spaced:
            for run in set(spaced_runs(text.lower())):
                reading = restore(run, self.cost, self.looks, spaced=True)
                out.update(reading.split())
                flat = reading.replace(" ", "")  # borders in it are guesses
                out.update(flat[i : i + k] for k in range(4, 13) for i in range(len(flat) - k + 1))
        return out


ALONE = np.zeros(256, bool)
ALONE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *map(ord, "@$!|+")]] = True
ALONE[0x80:] = True
INSIDE = ALONE.copy()
INSIDE[[*map(ord, TAIL)]] = False


def may_be_spaced(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which rows hold four characters that stand alone one after the other (at most three bytes between them)."""
    word = ALONE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True  # texts are apart
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]]))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) if len(data) else np.zeros(0, np.int64)
    seen = np.cumsum(INSIDE[data])
    more = seen[ends] - seen[starts] if len(data) else ends - starts  # bytes after the first, without a tail of look-alikes
    one = (more == 0) | ((more < 4) & (data[starts] >= 0x80)) if len(data) else more == 0  # one character has up to four bytes
    run = one[:-3] & one[1:-2] & one[2:-1] & one[3:] if len(one) > 3 else np.zeros(0, bool)
    out = np.zeros(len(offs) - 1, bool)
    out[np.searchsorted(offs, starts[: len(run)][run], side="right") - 1] = True
    return out


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]


def rank_of(token: str) -> int:
    return zlib.crc32(token.encode()) % RANKS


def texts(batch_column: pa.Array):
    """(row, text, whether spaced letters are worth a look) of a column."""
    for i, _, data, offs in chunks(batch_column):
        flags = may_be_spaced(data, offs)
        for r, (p, q) in enumerate(zip(offs, offs[1:], strict=False)):
            yield i + r, data[p:q].tobytes().decode("utf-8", "replace"), bool(flags[r])


def features_held(rows: DataFrame) -> tuple[int, int, dict[str, np.ndarray]]:
    """From rows(feature, text, before), with a row of feature '' for each text: the number of texts, in how many a
    feature must be, and the texts of each feature that is in enough of them and beside several words. Features are
    counted by the tasks; only those that are beside several words come to the driver."""
    times = F.size("texts")
    held = rows.groupBy("feature").agg(F.collect_set("text").alias("texts"), F.size(F.collect_set("before")).alias("neighbours"))
    # a word of one text's near copies always stands beside the same words, one that people use does not
    several = (times >= 2) & (F.col("neighbours") >= F.greatest(F.lit(2), F.least(F.lit(5), F.floor(times / 3))))
    got = held.filter(several | (F.col("feature") == "")).select("feature", "texts").toArrow().combine_chunks()
    names = got.column(0).to_pylist()
    lists = got.column(1).combine_chunks()
    ends, text = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    at = {f: text[ends[k] : ends[k + 1]] for k, f in enumerate(names)}
    known = np.sort(at.pop("", text[:0]))  # every text, so each gets its place among them as its number
    least = max(2, len(known) // 500)
    return len(known), least, {f: np.searchsorted(known, x).astype(np.int32) for f, x in at.items() if len(x) >= least}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, cost, n_toxic: int = 2000, n_clean: int = 6000, precision: float = 0.995, cover: int = 3, most_bytes: int = 1 << 17):
    """(weight of each learned feature, slope, offset, log-odds of each place of words), from docs(doc_id, text) with
    labels(doc_id, toxic) where `learn` holds. About n_toxic and n_clean labelled rows are drawn by digest before texts
    are joined to them; of those, texts of at most most_bytes bytes count. cost: what `character_model` gives."""
    sc = docs.sparkSession.sparkContext
    spot = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 7), 16, 10).cast("double") / float(1 << 28)
    known = labels.filter(learn).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("toxic") == 1).alias("toxic"), F.max(F.col("toxic") == 1).alias("__most")).filter("toxic = __most").drop("__most")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def sample(toxic: bool, most: int) -> DataFrame:
        drawn = known.filter((F.col("toxic") == F.lit(toxic)) & (spot < most / max(1, counts.get(toxic, 0)))).select(F.col("doc_id").alias("__drawn"))
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
        return rows.join(F.broadcast(drawn), F.col("doc_id") == F.col("__drawn"), "left_semi").select("text")

    bc = sc.broadcast(cost)

    def own_features(batches):
        """The features of each text's restored words, with a digest of those words and a hash of the token before each;
        a row without a feature for each text."""
        forget()
        r = Restorer(bc.value)
        for b in batches:
            for _, t, s in texts(b.column(0)):
                found = [(w, zlib.crc32(y.encode())) for w, y in sorted(r.in_order(t, s).items())]
                own = int.from_bytes(hashlib.blake2b(repr(found).encode(), digest_size=8).digest(), "big", signed=True)  # copies of one text count once
                rows = [("", 0), *((f, y) for w, y in found for f in features(w))]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array(np.full(len(rows), own)), pa.array([y for _, y in rows], pa.int64())], names=["feature", "text", "before"])

    n1, least, holds = features_held(sample(True, n_toxic).mapInArrow(own_features, "feature string, text long, before long"))
    names = sc.broadcast(frozenset(holds))

    def clean_counts(batches):
        forget()
        r, n, rows = Restorer(bc.value), Counter(), 0
        for b in batches:
            for _, t, s in texts(b.column(0)):
                n.update({f for w in r.words(t, s) for f in features(w)} & names.value)
                rows += 1
        n[""] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["feature", "n"])

    def ranks(batches):
        """How many texts hold a token of each place."""
        forget()
        n = np.zeros(RANKS, np.int64)
        for b in batches:
            for _, t, _ in texts(b.column(0)):
                n[list({rank_of(x) for x in t.split()})] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["place", "n"])

    def ranked(toxic: bool, most: int) -> np.ndarray:
        out = np.zeros(RANKS)
        got = sample(toxic, most).mapInArrow(ranks, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # RANKS rows at most
        out[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return out

    counted = sample(False, n_clean).mapInArrow(clean_counts, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    clean = dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist(), strict=True))
    n0 = clean.get("", 0)
    rate = lambda f, at: ((at + 0.5) / (n1 + 1), (clean.get(f, 0) + 0.5) / (n0 + 1))
    share = max(n1, 1) / max(n1 + n0, 1)
    surprise = lambda f, at: at * math.log(1 / share) + clean.get(f, 0) * math.log(1 / (1 - share) if share < 1 else 1) - entropy(at, clean.get(f, 0))
    needed = math.log(max(len(holds), 1)) + 1  # as many features are tried, so chance alone reaches about log(tries)
    precise = {f: at.tolist() for f, at in holds.items() if (not clean.get(f) or (x := rate(f, len(at)))[0] / sum(x) >= precision) and surprise(f, len(at)) >= needed}
    heap = [(-len(at), len(f), f) for f, at in precise.items()]
    heapq.heapify(heap)
    wanted, weights, stems = dict.fromkeys(range(n1), cover), {}, []  # features that each text may still ask for
    while heap:
        gain, length, f = heapq.heappop(heap)
        if any(g.startswith(f[1:]) or f[1:].startswith(g) for g in stems):
            continue  # says nothing that a picked one does not
        now = sum(wanted[i] > 0 for i in precise[f])
        if now < least:
            continue
        if now != -gain:
            heapq.heappush(heap, (-now, length, f))
            continue
        x = rate(f, len(precise[f]))
        stems.append(f[1:])
        weights[f] = math.log(x[0] / x[1])
        for i in precise[f]:
            wanted[i] -= 1
    few, many = ranked(True, n_toxic), ranked(False, n_clean)
    a, b = few.max(initial=0) + 2, many.max(initial=0) + 2
    odds = np.log((few + 1) / a) - np.log((many + 1) / b) if counts else np.zeros(RANKS)
    return weights, 1.5, 2.5, np.clip(odds, -4, 4).astype(np.float32)


def entropy(a: int, b: int) -> float:
    """Nats that a + b draws of two kinds cost at their own shares."""
    return -sum(x * math.log(x / (a + b)) for x in (a, b) if x)



def evidence(words: set[str], weights: dict[str, float]) -> float:
    return sum(max((weights.get(f, 0.0) for f in features(w)), default=0.0) for w in words)


def score_documents(df: DataFrame, cost: np.ndarray, model, text: str = "text", name: str = "score", passing: bool = False) -> DataFrame:
    """doc_id and its score between 0 and 1; with `passing`, all columns of df and the score (under `name`)."""
    bc = df.sparkSession.sparkContext.broadcast((cost, model))

    def run(batches):
        cost, (weights, slope, offset, odds) = bc.value
        _, r = kept(("toxicity", id(bc.value)), lambda: (bc.value, Restorer(cost, weights, odds)))  # the value is held, so its id stays its own
        for b in batches:
            scores = []
            for _, t, s in texts(b.column(0)):
                tokens = set(t.split())
                total = evidence(r.words(t, s, tokens), weights)
                total += r.mean_odds(tokens)  # between -1 and 1, of an offset of 2.5
                scores.append(1 / (1 + math.exp(-slope * (min(total, 20.0) - offset))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores, pa.float64())], schema=pa.schema([*list(b.schema)[1:], pa.field(name, pa.float64())]))

    rest = [F.col(f"`{c}`") for c in df.columns] if passing else [F.col("doc_id").cast("long").alias("doc_id")]
    df = df.select(F.col(text).cast("string").alias("__scored"), *rest)
    return df.mapInArrow(run, StructType([*df.schema.fields[1:], StructField(name, DoubleType())]))


def learned(docs: DataFrame, labels: DataFrame, learn: Column, **options):
    """The character model of all docs, and what labels teach where `learn` holds."""
    cost = character_model(docs)
    return cost, fit(docs, labels, learn, cost, **options)


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> DataFrame:
    """doc_id and score of every document."""
    return score_documents(docs, *learned(docs, labels, learn, **options))


def without_toxic(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs that score below the threshold, in one pass over them."""
    names = docs.columns
    scored = score_documents(docs, *learned(docs, labels, learn, **options), name="__toxicity", passing=True)
    return scored.filter(F.col("__toxicity") < threshold).select(*[F.col(f"`{c}`") for c in names])
