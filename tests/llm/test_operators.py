"""Each operator against a brute-force version, and its defined results for odd inputs."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

from driftlattice.llm import langid, licenses, mixing, neardup, ogg, pieces, quality, suffixdedup, textbuf, toxicity, warc
from driftlattice.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def prose(rng, n, syllables="the of and er tion ing al re st ou en".split()):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Prose with copies, near copies, shared passages, license lines; null, empty and odd texts."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(60, 300)) for _ in range(60)]
    passage = prose(rng, 40)
    for i in range(0, 20, 4):
        texts[i] = texts[i][:200] + passage + texts[i][200:]
    texts += [texts[3], texts[3], texts[7] + " end", " ".join(w if k % 60 else "new" for k, w in enumerate(texts[9].split()))]
    texts += [None, "", "", "   \n\t", "a", "\x00\x01", "é" * 40, "x" * 100, texts[5] + "\n" + texts[6], "All rights  reserved. CC-BY, Cc by; GNU General Public\nLicense"]
    return [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_licenses(docs, corpus, none):
    got = by_id(licenses.license_scan(docs))
    for i, text, *_ in corpus:
        w = words(text)
        base = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(base))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.license_scan(none).count() == 0


def test_fuzzy_notices(spark):
    rows = [(1, "x Relaesed under the MIT Licence y"), (2, "permission is hereby grantd, free of charge, to any person!"), (3, "nothing of the kind here"), (4, None)]
    got = by_id(licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1].labels == "mit" and got[1].n_base == 0 and 0.8 < got[1].score < 1
    m = got[1].matches[0]
    assert (m.first_word, m.last_word, m.base) == (1, 5, False) and m.edits >= 2
    assert got[2].labels == "mit" and got[3].labels == "" and got[3].score == 0 and got[4].n_words == 0


def edits(a, b):
    """Least insertions, deletions and substitutions."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, prev=row, x=x: min(left + 1, prev[j] + 1, prev[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


def labels_by_scan(text):
    """Labels of all notices that some words of a text spell within the edits allowed, key words included."""
    w, out = words(text), {label for phrase, label in licenses.BASE.items() if f" {phrase} " in f" {' '.join(words(text))} "}
    spans = lambda w, low, high: {x for i in range(len(w)) for j in range(i + 1, len(w) + 1) if low <= len(x := " ".join(w[i:j])) <= high}
    for label, notice in licenses.NOTICES:
        k = max(1, len(notice) // 10)
        for x in spans(w, len(notice) - k, len(notice) + k):
            near = lambda key, x=x: any(edits(y, key) <= len(key) // 5 for y in spans(x.split(), len(key) - len(key) // 5, len(key) + len(key) // 5))
            if edits(x, notice.lower()) <= k and all(near(key.lower()) for key in notice.split() if key.isupper()):
                out.add(label)
                break
    return ",".join(sorted(out))


def test_fuzzy_labels_equal_an_edit_scan(spark):
    rng = random.Random(17)
    rows = []
    for _, notice in licenses.NOTICES:
        for n in range(7):  # none to six edits, then others' key words
            t = list(notice.lower())
            for _ in range(n):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [rng.choice("abcdei ")], [t[i], rng.choice("abcdei")]])
            rows.append("we say " + "".join(t) + " and so on")
    rows += [f"This is released under the {x} license." for x in "bsd gpl isc mit apache nit public m it".split(" ")] + ["gnu affero general public license", "GNU Lesser General Public License", "all lights reversed", "the general public", ""]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("matches", F.lit(1))
    got = by_id(licenses.license_scan(df))
    assert {i: got[i].labels for i in got} == {i: labels_by_scan(t) for i, t in enumerate(rows)}
    assert all("mit" not in got[i].labels for i, t in enumerate(rows) if re.search("the (bsd|gpl|isc|nit) license", t))
    long = spark.createDataFrame([(1, "word " * 400_000 + rows[0]), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.labels) for r in licenses.license_scan(long).collect()) == [(1, 400_000 + len(words(rows[0])), "agpl,gpl"), (2, 0, "")]


def removed_by_scan(rows):
    """The digest columns of suffix dedup, from the set of all strings of 50 bytes in documents before."""
    seen, expected = set(), {}
    for i, text in rows:
        raw = (text or "").encode()
        own = [raw[p : p + 50] for p in range(len(raw) - 49)]
        gone = bytearray(len(raw))
        for p, s in enumerate(own):
            if s in seen:
                gone[p : p + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        expected[i] = (i, len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return expected


def test_a_phrase_in_all_documents(spark):
    """A phrase whose contexts differ everywhere: its anchors are heavy, and their windows are dealt by all their bytes."""
    import numpy as np

    rng = random.Random(31)
    phrase = "all rights in this phrase are reserved by nobody"
    rows = [(i, prose(rng, rng.randint(0, 12)) + phrase + rng.choice(["", " ", " and", " and so on"]) + prose(rng, rng.randint(0, 12))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = removed_by_scan(rows)
    assert sum(x[2] > 0 for x in expected.values()) > 40
    for size in (1_000, 20_000):
        assert {r.doc_id: tuple(r) for r in suffixdedup.dedup(df, group_bytes=size, heavy=20).collect()} == expected
    raw = "".join(t for _, t in rows).encode()
    data, offs = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in rows])])
    row, place, h, low, high = suffixdedup.anchors(data, offs)
    top = np.unique(h, return_counts=True)[1].max()
    names = np.zeros((len(h), 10 + suffixdedup.WIDTH), np.uint8)
    names[:, 8], names[:, 9], names[:, 10:] = low, high, suffixdedup.contexts(data, place, low, high)
    windows = suffixdedup.HeavyWindows(names, row.astype(np.int64), np.ones(len(h), bool), 64)
    assert top > 300 and max(len(x) for _, x in windows.parts) < len(windows.windows) / 20  # one key held them, 64 buckets share them


def test_suffix_dedup(spark, docs, corpus, none):
    expected = removed_by_scan([(i, t) for i, t, *_ in corpus])
    for size, heavy in ((2_000, 4096), (1 << 20, 4096), (2_000, 2), (1 << 20, 0)):
        assert {r.doc_id: tuple(r) for r in suffixdedup.dedup(docs, group_bytes=size, heavy=heavy).collect()} == expected
    assert suffixdedup.dedup(none).count() == 0
    same = spark.createDataFrame([(1, "q" * 80), (1, "q" * 80), (None, "q" * 80)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in suffixdedup.dedup(same).collect())
    assert got == [(False, 0), (False, 0), (True, 80)]
    kept = suffixdedup.without_repeats(docs.withColumn("Extra", F.lit(1)))
    assert kept.columns == [*docs.columns, "Extra"] and kept.filter("doc_id = 60").count() == 0 and kept.filter("doc_id = 3").count() == 1


def test_levels_merge_geometrically():
    import numpy as np

    levels = suffixdedup.Levels()
    for k in range(64):
        levels.scan(np.array([f"{k:050d}".encode()], "S50"), np.array([k]))
    assert len(levels.levels) <= 8 and sum(len(x) for x, _ in levels.levels) == 64
    assert levels.scan(np.array([b"%050d" % 3], "S50"), np.array([99])).all()


def shingles(text, k=5):
    w = words(text)
    return Counter(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else Counter([tuple(w)] if w else [])


def test_near_duplicates(spark, docs, corpus, none):
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert set(got) == {i for i, *_ in corpus}
    sets = {i: set(shingles(t)) for i, t, *_ in corpus}
    for (a, ta, *_), (b, tb, *_) in itertools.combinations(corpus, 2):
        j = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
        if (ta or "") == (tb or "") or j > 0.87:
            assert got[a] == got[b], (a, b, j)
        if j < 0.7 and (ta or "") != (tb or ""):
            assert got[a] != got[b], (a, b, j)
    assert all(c == min(i for i in got if got[i] == c) for c in got.values())
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.one_of_each(docs.withColumn("sig", F.lit("x")))
    assert kept.columns == [*docs.columns, "sig"] and kept.count() == len(set(got.values()))


def test_consistent_weighted_samples_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    w = rng.uniform(0.5, 5, 400)
    a, b = np.arange(0, 300), np.arange(60, 400)
    sig = neardup.samples(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([h[a], h[b]]), np.concatenate([w[a], w[b]]), 2, 4000)
    shared = np.intersect1d(a, b)
    true = w[shared].sum() / (w[a].sum() + w[b].sum() - w[shared].sum())
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def with_digest(df):
    return df.select("doc_id", neardup.digest_of(F.col("text")).alias("digest"), "text")


def test_many_copies_send_few_links(spark):
    rng = random.Random(1)
    base = prose(rng, 400).split()
    rows = [(i, " ".join(w if rng.random() > 0.004 else "zz" for w in base)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idf, _ = neardup.document_frequencies(df)
    nodes = neardup.signatures(with_digest(df), idf).withColumnRenamed("doc_id", "node")
    links = neardup.candidates(neardup.buckets(nodes), nodes.select("node", "packed"), 0.62, chunk=64)
    assert links.count() < 300 * neardup.BANDS
    assert {r.class_id for r in neardup.near_duplicates(df, chunk=64).collect()} == {0}


def classes_of_all_pairs(df, rows, threshold=0.8, least=30):
    """The class of each text, out of all pairs that share a band, agree in `least` samples and are similar enough."""
    import numpy as np
    import pyarrow as pa

    idf, _ = neardup.document_frequencies(df)
    sig = {r.doc_id: np.array(r.sig) for r in neardup.signatures(with_digest(df), idf).collect()}
    known = {i: dict(zip(*(x.tolist() for x in neardup.features(pa.array([t]), idf)), strict=True)) for i, t in rows}
    of = {i: i for i in known}
    for a, b in itertools.combinations(sorted(known), 2):
        same = sig[a] == sig[b]
        if same.sum() < least or not same.reshape(neardup.BANDS, neardup.ROWS).all(1).any():
            continue
        x, y = known[a], known[b]
        shared = sum(min(x[h], y[h]) for h in x.keys() & y.keys())
        n = len(x.keys() & y.keys())
        if max(shared / (sum(x.values()) + sum(y.values()) - shared), n / (len(x) + len(y) - n)) >= threshold:
            low, high = sorted((of[a], of[b]))
            of = {i: low if c == high else c for i, c in of.items()}
    return of


def framed(rng, n, lengths, frame=100):
    """n texts of one frame, in each of which a run of words (of one of `lengths`) is its own."""
    base = prose(rng, frame).split()
    out = []
    for i in range(n):
        k = rng.choice(lengths)
        at = rng.randrange(frame - k)
        out.append((i, " ".join([*base[:at], *(f"w{i}x{j}" for j in range(k)), *base[at + k :]])))
    return out


def test_split_buckets_lose_no_pair(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    sig = rng.integers(1, 1 << 62, (64, neardup.BANDS * neardup.ROWS))
    sig[:, :28] = sig[0, :28]  # seven bands that all share, but too few samples to agree
    sig[1::2, 28::4] = sig[::2, 28::4]  # twins agree in 33 of 48, and share no other band
    rows = [(i, 100, s.tolist(), bytearray((s.astype(np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes())) for i, s in enumerate(sig)]
    df = spark.createDataFrame(rows, "node long, n_shingles long, sig array<bigint>, packed binary")
    of = components(spark.createDataFrame([(0, 1)], "a long, b long"))
    for chunk, size in ((8, 1 << 20), (4096, 1 << 20), (4096, 900)):
        found = neardup.flagged(neardup.blocks(neardup.buckets(df), df.select("node", "packed"), of, chunk, size), 0.62).collect()
        assert {r.x for r in found} == set(range(2, 64))  # all twins but those that are one component already
        assert {r.band for r in found} == {0}  # each pair in the first band that it shares


def test_links_beyond_the_strongest_are_tried(spark):
    rng = random.Random(12)
    rows = framed(rng, 150, [2, 3, 5, 6, 7])  # similarities spread around the threshold
    rows += [(2000 + i, prose(rng, 100)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = classes_of_all_pairs(df, rows)
    assert 5 < sum(expected[i] == i for i in range(150)) < 145
    for chunk in (4096, 16):
        assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df, chunk=chunk).collect()} == expected


def recall(got, rows, threshold=0.8):
    """Of the pairs of different texts with a Jaccard similarity of at least `threshold`, the share in one class."""
    sets = {i: set(shingles(t)) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return len(pairs), sum(got[a] == got[b] for a, b in pairs) / max(1, len(pairs))


def test_recall_on_one_cluster(spark):
    """A corpus of nothing but near copies, edited by words of their own, and the same beside other texts."""
    rng = random.Random(21)
    rows = framed(rng, 250, [1, 2, 4, 6, 8, 12], frame=150)
    for more in ([], [(5000 + i, prose(rng, 120)) for i in range(400)]):
        df = spark.createDataFrame(rows + more, "doc_id long, text string")
        n, found = recall({r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}, rows)
        assert n > 5000 and found >= 0.95, (n, found)


def test_texts_that_share_a_doc_id(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a), (1, b), (2, b + " end"), (3, c), (3, c), (None, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    kept = sorted(((r.doc_id or 0), r.text) for r in neardup.one_of_each(df).collect())
    assert kept == sorted([(0, a), (0, a), (1, a), (1, b), (3, c)])
    empty = spark.createDataFrame([(1, "")] * 3 + [(2, None), (3, "..."), (4, "x" * 200_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(empty).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}


def test_components_over_several_tasks(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    for most in (1, 7):
        got = {r.node: r.component for r in components(chain, most=most).collect()}
        assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}
    assert components(chain.limit(0)).count() == 0


def test_few_links_take_few_jobs(spark):
    """What the driver keeps of jobs and plans doesn't follow the length of a chain that a task can join."""
    rng = random.Random(2)
    names = rng.sample(range(10_000), 3000)
    links = spark.createDataFrame([*itertools.pairwise(names)], "a long, b long")
    spark.sparkContext.setJobGroup("links", "links")
    try:
        got = components(links)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("links")) <= 8
    assert {tuple(r) for r in got.collect()} == {(x, min(names)) for x in names}


def test_pieces_match_the_library():
    e, sp = pieces.Encoder(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(3)
    texts = ["", " ", "a", "\n\n", "the  cat", "日本語 😀 é", "x" * 5000, "▁a", "a\tb", "..,” »,"]
    texts += ["".join(rng.choice("ab the.,\n1é”_") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    for t in texts:
        assert e.encode(t) == sp.encode(t), t
        assert "▁" in t or e.decode(e.encode(t)) == t
        assert list(e.stream("▁" + t.replace(" ", "▁"))) == sp.encode(t) or not t


def test_unigram_paths_equal_brute_force():
    e = pieces.Encoder()
    e.unigram, e.longest = True, 3
    scored = {"a": -2.0, "b": -2.5, "ab": -3.1, "ba": -4.0, "aba": -5.0, "bb": -4.1, "c": -1.0, "bc": -3.0}
    e.names, e.ids = list(scored), {p: i for i, p in enumerate(scored)}
    e.score_of, e.floor, e.unknown, e.bytes_id = list(scored.values()), -20.0, 99, {}
    e.begins = {p[:k]: -1 for p in scored for k in range(1, len(p))} | e.ids

    def best(text):
        paths = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            known = [(paths[at][0] + scored[x], paths[at][1] + [e.ids[x]]) for at in range(max(0, end - 3), end) if (x := text[at:end]) in scored]
            paths[end] = max(known or [(paths[end - 1][0] - 20.0, paths[end - 1][1] + [99])], key=lambda p: p[0])
        return paths[len(text)]

    rng = random.Random(9)
    for n in [*range(1, 40), 200, 1000]:
        text = "".join(rng.choice("abcx") for _ in range(n))
        ids = list(e.stream(text))
        assert sum(e.score_of[k] if k != 99 else -20.0 for k in ids) == pytest.approx(best(text)[0])
        assert "".join("x" if k == 99 else e.names[k] for k in ids) == text
    e.scored = {"ab": -1.0, "ba": -1.0, "a": -1.0, "b": -1.0}  # two readings of a long row stay level to its end
    e.names, e.longest = list(e.scored), 2
    e.ids = {p: i for i, p in enumerate(e.names)}
    e.begins, e.score_of = dict(e.ids), list(e.scored.values())
    assert len(list(e.stream("ab" * 500))) == 500 and len(list(e.stream("ab" * 500 + "a"))) == 501


def test_round_trip_sees_a_wrong_id(monkeypatch):
    e = pieces.Encoder()
    assert e.decoded(e.encode("the cat")) == b"the cat" and e.decoded(e.encode("the cat")[:-1]) != b"the cat"
    texts = list(e.texts)
    texts[e.encode("the")[0]] = b"?"
    monkeypatch.setattr(e, "texts", texts)
    assert e.decoded(e.encode("the cat")) != b"the cat"  # what round_trip compares, for the ids of each text


def test_pieces_commit_in_a_bounded_window():
    e = pieces.Encoder()
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    stream, first = e.stream(text), []
    for k, i in enumerate(stream):
        first.append(i)
        if k == 10:
            break
    assert e.encode(text)[:5] and len(first) == 11  # ids come before the whole text is read


def test_encode_documents(docs, none, corpus):
    got = by_id(pieces.encode_documents(docs))
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in got.values())
    assert [got[i].n_ids for i, t, *_ in corpus if not t] == [0, 0, 0]
    back = by_id(pieces.decode_documents(pieces.encode_documents(docs)))
    assert all(back[i].text == (t or "") for i, t, *_ in corpus)
    assert pieces.encode_documents(none).count() == 0


def test_quality(docs, corpus, none):
    got = by_id(quality.quality_rules(docs))
    for i, text, *_ in corpus:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + o for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality_rules(none).count() == 0
    clash = quality.quality_rules(docs.select("*", *[F.lit("x").alias(c) for c in ("N_Words", "__t", "__w", "__l", "__o", "__rest0", "a b")]))
    assert "n_words" in clash.columns and "N_Words" not in clash.columns
    assert {r.doc_id: (r.n_words, r["__w"], r["a b"]) for r in clash.collect()} == {i: (r.n_words, "x", "x") for i, r in got.items()}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(2)
    kinds = {"xx": "the of and er tion ing".split(), "yy": "der die sch ung ein ich".split(), "zz": "que los ado ción mente ar".split()}
    return spark.createDataFrame([(i, prose(rng, rng.randint(5, 80), kinds[k]), k) for i, k in enumerate(rng.choices(list(kinds), k=200))] + [(500, None, "xx"), (501, "12 34", None), (502, "", "yy")], "doc_id long, text string, lang string")


def test_language(spoken, none):
    held = textbuf.held_out(F.col("doc_id"))
    model = langid.fit(spoken, ~held, per_language=40, landmarks=10)
    got = by_id(langid.identify(spoken, model))
    rows = spoken.withColumn("held", held).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tested = [r for r in rows if r.held and r.text and any(c.isalpha() for c in r.text)]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in tested) / len(tested) > 0.95
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    repeated = spoken.union(spoken.filter("doc_id = 1").crossJoin(spoken.sparkSession.range(500)).drop("id"))
    again = langid.fit(repeated, ~held, per_language=40, landmarks=10)
    assert again[0] == model[0] and all((x == y).all() for x, y in zip(again[1:], model[1:], strict=True))  # a doc_id is one row of the sample
    assert langid.fit(none, F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(spoken, None).collect()} == {"und"}


def test_language_equals_the_kernel_form(spoken):
    """Sets of n-grams, and the dual solution of the ridge regression over Nystroem's kernel of all learned texts."""
    import numpy as np

    def places(text):
        raw = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.encode().lower())
        grams = {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}
        spot = {1: lambda v: v, 2: lambda v: 256 + (v * 40503 >> 4) % (langid.DIMS - 256), 3: lambda v: 256 + (v * 2654435761 >> 11) % (langid.DIMS - 256)}
        return {spot[len(g)](int.from_bytes(g, "big")) for g in grams}

    def k(a, b):
        return np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in b] for x in a])

    rows = sorted((r.doc_id, r.lang, r.text) for r in spoken.collect() if r.lang and r.text)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    langs, n_marks, ridge = sorted({r[1] for r in learned}), 12, 1e-2
    sets = [places(t) for *_, t in learned]
    marks = [s for c in langs for s in [s for s, r in zip(sets, learned, strict=True) if r[1] == c][:n_marks]]
    weight = np.array([1 / sum(q[1] == r[1] for q in learned) for r in learned])
    inverse = np.linalg.inv(k(marks, marks))
    near = k(sets, marks)
    signs = np.array([[1.0 if r[1] == c else -1.0 for c in langs] for r in learned])
    alpha = np.linalg.solve(near @ inverse @ near.T + 1 + ridge * np.diag(1 / weight), signs)
    expected = (k([places(t) for *_, t in rows], marks) @ inverse @ near.T + 1) @ alpha

    model = langid.fit(spoken, ~textbuf.held_out(F.col("doc_id")), per_language=1000, landmarks=n_marks, ridge=ridge)
    clash = spoken.select("*", *[F.lit("x").alias(c) for c in ("lang_pred", "score", "bits", "key")])
    got = by_id(langid.identify(clash, model))
    assert model[0] == langs
    for (i, *_), f in zip(rows, expected, strict=True):
        top = np.sort(f)
        assert got[i].score == pytest.approx(min(max((top[-1] + 1) / 2, 0), 1), abs=2e-3)
        assert got[i].lang_pred == langs[f.argmax()] or top[-1] - top[-2] < 2e-3


def test_very_long_texts(spark):
    """Texts beyond the operators' chunks, beside short ones, against the same scans of whole texts."""
    rng = random.Random(12)
    part = prose(rng, 120)
    long = prose(rng, 250_000) + " Cc by " + part + " all rights reserved"
    assert len(long) > 1 << 20
    rows = [(1, part, "en", "a", 0), (2, long, "en", "a", 0), (3, part + " end", "en", "b", 0), (4, "cc by " + part, "en", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: tuple(r) for r in suffixdedup.dedup(df, group_bytes=1000).collect()} == removed_by_scan([(i, t) for i, t, *_ in rows])
    licensed = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_scan(df).collect()}
    n = len(words(long))
    assert licensed[2] == (n, 2, n - len(words(part)) - 5, n - 3, "cc-by,reserved") and licensed[4][1:4] == (1, 0, 0)
    judged = {r.doc_id: (r.n_words, r.word_chars) for r in quality.quality_rules(df).collect()}
    assert judged == {i: (len(w), sum(map(len, w))) for i, t, *_ in rows for w in [re.findall(r"[^\x20\x09-\x0D]+", t)]}
    mixed = by_id(mixing.mix(df))
    assert all(mixed[i].size == judged[i][0] and mixed[i].taken <= 2 * mixed[i].size for i in mixed)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 1}


def test_toxicity(spark, none):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        t = prose(rng, 60).split()
        toxic = i % 5 == 0
        if toxic:
            t[rng.randrange(60)] = rng.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    rows += [(1000, prose(rng, 60) + " 1d10t"), (1001, prose(rng, 60) + " m o r o n end"), (1002, prose(rng, 60) + " iiiidiot"), (1003, None), (1004, "")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.toxicity_scores(df, lab, ~textbuf.held_out(F.col("doc_id"))))
    assert all((got[i].score >= 0.5) == bool(t) for i, t in labels)
    assert all(got[i].score >= 0.5 for i in (1000, 1001, 1002)) and got[1003].score == got[1004].score < 0.5
    assert len({round(got[i].score, 9) for i, t in labels if not t}) > 50  # texts without a listed word are ranked too
    both = spark.createDataFrame([(0, 0), (0, 0)], "doc_id long, toxic int").union(lab)  # 0 is labelled both ways
    assert {i: r.score >= 0.5 for i, r in by_id(toxicity.toxicity_scores(df, both, F.lit(True))).items()} == {i: r.score >= 0.5 for i, r in got.items()}
    long = spark.createDataFrame([(7, "calm words " * 200_000 + "idiot"), (8, "calm words " * 200_000)], "doc_id long, text string")
    scored = by_id(toxicity.toxicity_scores(df.union(long), lab, F.lit(True)))
    assert scored[7].score >= 0.5 > scored[8].score
    kept = toxicity.without_toxic(df.withColumn("score", F.lit(1)), lab, F.lit(True))
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 322
    assert toxicity.toxicity_scores(none, lab, F.lit(True)).count() == 0
    assert {r.score < 0.5 for r in toxicity.toxicity_scores(df, lab.limit(0), F.lit(True)).collect()} == {True}


def test_words_of_one_text_stay_with_the_tasks(spark, monkeypatch):
    """Of the labelled texts' words the driver gets those that a word list may use, however many others there are."""
    rng = random.Random(9)
    own = [["".join(rng.choices("bcdfglmnprst", k=9)) for _ in range(400)] for _ in range(60)]
    rows = [(i, " ".join(x + (["idiot", x[0], "moron"] if i % 2 else []))) for i, x in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    cost, seen, plain = toxicity.character_model(docs), [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: seen.append(got := plain(df)) or got)
    weights = toxicity.fit(docs, labels, F.lit(True), cost)[0]
    assert any("idiot".startswith(f[1:]) for f in weights)
    held = " ".join(str(t.column(0).to_pylist()) for t in seen)
    assert "idiot" in held and not any(w in held for x in own for w in x)


def test_restoring():
    import numpy as np

    cost = np.full((28, 28, 28), 3.0).tolist()
    looks = {c: dict.fromkeys(x, 1.0) for c, x in toxicity.LOOKS.items()}
    assert toxicity.restore("st00pid", cost, looks) == "stoopid" and toxicity.restore("plain", cost, looks) == "plain"
    assert toxicity.spaced_runs("say i d i o t now") == ["idiot"] and toxicity.spaced_runs("a b c") == []


def all_readings(observed, cost, looks, spaced):
    """Every reading of a word with its cost, one character after the other."""
    paths = [((0, 0), "", "", 0.0)]  # last two codes, the last letter, the reading, the cost
    for i, seen in enumerate(observed):
        drawn = seen * 3 in observed[max(0, i - 2) : i + 3]
        options = ([(seen, 0.0)] if seen.isalpha() else []) + list(looks.get(seen, {}).items()) or [(seen, 0.0)]
        after = []
        for (a, b), letter, reading, total in paths:
            for c, extra in options:
                k = toxicity.code(c)
                after.append(((b, k), c, reading + c, total + extra + cost[a][b][k]))
                if c == letter and drawn:
                    after.append(((a, b), letter, reading, total + extra + toxicity.REPEAT))
                if spaced and reading:
                    after.append(((0, k), c, reading + " " + c, total + extra + toxicity.BREAK + cost[a][b][0] + cost[b][0][k]))
        paths = after
    return {reading: min(t + cost[a][b][0] for (a, b), _, r, t in paths if r == reading) for _, _, reading, _ in paths}


def test_restoring_equals_brute_force():
    import numpy as np

    rng = random.Random(23)
    cost = np.random.default_rng(3).uniform(0.5, 6, (28, 28, 28)).tolist()
    looks = {c: {y: rng.uniform(0.2, 3) for y in x} for c, x in toxicity.LOOKS.items()}
    for n in range(300):
        observed = "".join(rng.choice("ai1l|!eé3sooo$") for _ in range(rng.randint(1, 6)))
        spaced = n % 3 == 0
        found, readings = toxicity.restore(observed, cost, looks, spaced), all_readings(observed, cost, looks, spaced)
        assert readings[found] == pytest.approx(min(readings.values())), observed


def test_channel_learns_what_fits():
    import numpy as np

    p2 = np.full((28, 28), 0.01)
    p2[1, 9], p2[9, 2] = 0.5, 0.5  # a-i and i-b are common, a-l and l-b are not
    seen = np.zeros((len(toxicity.LOOK_BYTES), 28, 28))
    seen[toxicity.LOOK_BYTES.index("1"), 1, 2] = 1000
    learned = toxicity.channel(seen, p2)
    assert learned["1"]["i"] < 0.1 < learned["1"]["l"] and learned["|"]["i"] > 3 and set(learned) == set(toxicity.LOOKS)


def test_restoring_at_the_end_of_words():
    import numpy as np
    import pyarrow as pa

    known = toxicity.Restorer((np.full((28, 28, 28), 3.0), {c: dict.fromkeys(x, 1.0) for c, x in toxicity.LOOKS.items()}))
    for token, word in {"a$$": "ass", "shi+": "shit", "pus$": "puss", "@$$": "ass", "(a$$).": "ass", "shi+!": "shit", "a$$!!!": "ass"}.items():
        assert word in known.readings(token), token
    assert known.readings("plain!")[0] == "plain" and known.readings("455") == () and known.readings("") == ()
    assert toxicity.spaced_runs("s h i t!") == toxicity.spaced_runs('"s, h, i, t"') == ["shit"]
    assert [x for _, _, x in toxicity.texts(pa.array(["s h i t!", "$ h i t!", "no such run", "", None]))] == [True, True, False, False, False]


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/é b", "<p>x"), (2, "u2", "<p>x"), (3, "u3", None), (4, "u4", ""), (None, None, "null id"), (6, "u6", "y" * 300_000), (7, "u", "ü"), (7, "u", "ü")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.archive(pages, str(tmp_path / "w"))
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = next((h or "").encode() for p, u, h in rows if p == r.page_id and (u or "") == r.url)
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (bytes(r.payload) == raw) if r.record_type == "response" else (r.payload is None and r.refers_to > r.page_id)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "response", None), (1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (6, "response", None), (7, "response", None), (7, "response", None)]
    small = warc.read_archive(spark, path, range_bytes="1", payload="false")
    assert small.filter("record_type = 'revisit'").count() == 2 and small.filter("page_id = 6").head().payload is None
    empty = warc.archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, empty).count() == 0


def test_foreign_archives(spark, tmp_path):
    import gzip

    def foreign(kind, block, content="application/http; msgtype=response", more=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: http://a/%20\r\n{more}Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    body = b"<p>" + b"x" * 5000
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (body[:10], body[10:])) + b"0\r\n\r\n"
    whole = b"HTTP/1.1 200 OK\r\nServer: a\r\n b\r\n\r\n" + body
    records = [foreign("warcinfo", b"software: x\r\n", "application/warc-fields"), foreign("response", chunked), foreign("response", whole, more=f"WARC-Block-Digest: sha1:{warc.sha1(whole)}\r\nWARC-Payload-Digest: sha1:{warc.sha1(body)}\r\n"), foreign("request", b"GET / HTTP/1.1\r\n\r\n", "application/http; msgtype=request")]
    plain, packed = tmp_path / "f", tmp_path / "z"
    plain.mkdir()
    packed.mkdir()
    (plain / "a.warc").write_bytes(b"".join(records))
    (packed / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (packed / "notes.txt").write_text("no archive")
    for path in (plain, packed, packed / "a.warc.gz"):
        got = warc.read_archive(spark, str(path)).collect()
        assert sorted(r.record_type for r in got) == ["request", "response", "response", "warcinfo"]
        assert all(bytes(r.payload) == body and r.payload_bytes == len(body) and r.payload_digest == warc.sha1(body) for r in got if r.record_type == "response")
        assert {r.url for r in got} == {"http://a/%20"} and {r.page_id for r in got} == {None}
        found = warc.read_archive(spark, str(path))
        assert found.filter(F.col("payload_digest") == warc.sha1(body)).count() == 2 and found.filter("record_type = 'request'").count() == 1
        assert warc.read_archive(spark, str(path), payload="false").filter("payload IS NULL").count() == 4
    (plain / "a.warc").write_bytes(b"".join(records).replace(b"x" * 5000, b"x" * 4999 + b"y"))
    (packed / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records))[:-20])
    for path in (plain, packed, tmp_path / "none"):
        with pytest.raises(Exception):  # noqa: B017
            warc.read_archive(spark, str(path)).collect()


def test_records_have_the_mandatory_fields():
    import io

    made = [warc.record(7, "http://a/ü", kind, 9, b"abc" * 40, "http://b/") for kind in ("response", "revisit", "revisit")]
    heads = [warc.header(io.BytesIO(r)) for r in made]
    assert all(h[f] for h in heads for f in ("warc-record-id", "warc-date", "warc-type", "content-length"))
    assert len({h["warc-record-id"] for h in heads}) == 3 and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", h["warc-record-id"]) for h in heads)
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["warc-date"]) and h["warc-target-uri"].isascii() for h in heads)
    assert heads[1]["warc-refers-to-target-uri"] == "http://b/" and warc.payload_of(made[0].partition(b"\r\n\r\n")[2][:-4]) == b"abc" * 40


def test_damaged_archive(tmp_path):
    raw = warc.record(1, "u", "response", None, b"abc" * 50)
    (tmp_path / "a.warc").write_bytes(raw.replace(b"\r\n\r\n", b"\r\n\r\nX", 1))
    reader = warc.Reader({"path": str(tmp_path)})
    with pytest.raises(Exception):  # noqa: B017
        list(reader.read(warc.Range(str(tmp_path / "a.warc"), 0, len(raw))))


def test_ogg(docs, corpus, none):
    got = by_id(ogg.media_columns(docs, with_media=True))
    for i, text, *_ in corpus:
        raw = (text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert got[60].media_sha256 == got[3].media_sha256 and ogg.media_columns(none).count() == 0


def cut_pages(media):
    """The pages of a physical stream, by the lengths in their own headers."""
    out = []
    while media:
        n = 27 + media[26] + sum(media[27 : 27 + media[26]])
        out.append(media[:n])
        media = media[n:]
    return out


def test_ogg_pages():
    for n in (64, 1200, 4080, 4096, 61_200, 61_264, 200_000, 255 * 16 * 5):
        samples = random.Random(n).randbytes(n)
        media = ogg.write(samples)
        streams = ogg.read(media)
        assert set(streams) == {ogg.SAMPLES, ogg.NOTES} and streams[ogg.NOTES][1][0] == str(n).encode()
        assert ogg.samples_of(streams) == (samples, n / ogg.RATE)
        own = cut_pages(media)
        assert n < 5000 or any(p[5] & ogg.CONTINUED for p in own)  # packets run over page breaks
        for k in range(len(own)):  # any page lost, repeated or damaged
            for bad in (own[:k] + own[k + 1 :], own[: k + 1] + own[k:]):
                with pytest.raises(ValueError):
                    ogg.samples_of(ogg.read(b"".join(bad)))
            if k == len(own) - 1:
                break
        damaged = bytearray(media)
        damaged[len(damaged) // 2] ^= 1
        for bad in (bytes(damaged), media[:-1], media[: len(media) // 2], b"x" + media):
            with pytest.raises(ValueError):
                ogg.samples_of(ogg.read(bad))


def test_foreign_ogg():
    """Pages of other sizes: a packet over three pages, one that ends in a full segment, an empty page, interleaved streams."""
    a = [b"PCM     ", b"a" * 600, b"b" * 255, b""]
    one = ogg.pages(a[:1], [0], 1, first=True) + ogg.pages(a[1:], [600, 855, 855], 1, 1, segments=1, last=True)
    two = ogg.pages([b"other"], [0], 7, first=True) + ogg.pages([b"c" * 70_000], [5], 7, 1, segments=255, last=True)
    mixed = [p for pair in itertools.zip_longest(one, two) for p in pair if p]
    streams = ogg.read(b"".join(mixed))
    assert [p for p, _ in streams[1]] == a and [p for p, _ in streams[7]] == [b"other", b"c" * 70_000]
    assert ogg.samples_of(streams) == (b"a" * 600 + b"b" * 255, 855 / ogg.RATE)
    with pytest.raises(ValueError):  # a granule that counts more samples than there are
        ogg.samples_of(ogg.read(b"".join(one[:1] + ogg.pages([b"abc"], [4], 1, 1, last=True))))
    with pytest.raises(ValueError):  # a granule that goes back
        ogg.read(b"".join(one[:1] + ogg.pages([b"a" * 300, b"b"], [300, 200], 1, 1, segments=2, last=True)))


def filled(sizes, share=1.5, most=2.0):
    """Shares by weight, capped and shared again until none is above."""
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(keys)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        free = [k for k in keys if k not in capped]
        level = (left - sum(capped.values())) / sum(weight[k] for k in free) if free else 0
        over = [k for k in free if weight[k] * level > most * sizes[k]]
        if not over:
            return {**capped, **{k: weight[k] * level for k in free}}
        capped |= {k: most * sizes[k] for k in over}


def test_mixing(docs, corpus, none):
    got = by_id(mixing.mix(docs, block=8, shard_tokens=1000))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in corpus}
    sources = {i: s for i, _, _, s, _ in corpus}
    total = Counter()
    for i, s in sources.items():
        total[s] += size[i]
    target, taken = filled(dict(total)), Counter()
    for i, r in got.items():
        assert r.size == size[i] and r.source_size == total[sources[i]] and r.target == pytest.approx(target[sources[i]])
        assert 0 <= r.taken <= 2 * r.size
        taken[sources[i]] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max(0.03 * target[s], 40)
    again = by_id(mixing.mix(docs.repartition(5), block=8, shard_tokens=1000))
    assert {i: r.taken for i, r in again.items()} == {i: r.taken for i, r in got.items()}
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs, block=8, shard_tokens=1000)
    assert mixed.columns == docs.columns
    words_out = Counter()
    for r in mixed.collect():
        words_out[r.doc_id] += len(r.text.split())
    assert all(words_out[i] == r.taken for i, r in got.items() if r.size and "\x00" not in (corpus[i][1] or ""))


def test_mixing_odd_inputs(spark, docs):
    extra = docs.select("*", *[F.lit("x").alias(c) for c in ("Target", "rank", "turn", "quota", "digest", "start", "__row", "__n", "one two")])
    plain = by_id(mixing.mix(docs))
    got = mixing.mix(extra)
    assert "Target" not in got.columns and {"target", "rank", "quota", "__row", "one two"} <= set(got.columns)
    assert {r.doc_id: (r.taken, r.rank, r["__n"]) for r in got.collect()} == {i: (r.taken, "x", "x") for i, r in plain.items()}
    mixed = mixing.mixed_documents(extra)
    assert mixed.columns == extra.columns and sorted((r.doc_id, r.text) for r in mixed.collect()) == sorted((r.doc_id, r.text) for r in mixing.mixed_documents(docs).collect())
    few = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", "y"), (2, "d e", "y"), (3, None, "z"), (4, "w " * 300_000, None), (None, "n n n", "x")], "doc_id long, text string, source string")
    rows = mixing.mix(few).collect()
    taken, sizes, target = Counter(), Counter(), {r.source: r.target for r in rows}
    for r in rows:
        taken[r.source] += r.taken
        sizes[r.source] += r.size
    assert target == pytest.approx(filled(dict(sizes))) and all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    one = mixing.mix(few.limit(1)).head()
    assert (one.size, one.target, one.taken) == (3, 4.5, 4) or (one.size, one.target, one.taken) == (3, 4.5, 5)


def test_sainte_lague(spark):
    votes = {"a": 53_000, "b": 24_000, "c": 23_000, "d": 1, "e": 0}
    for seats in (1, 7, 21, 100):
        won = Counter()
        for _ in range(seats):
            won[min((k for k in votes), key=lambda k: (-votes[k] / (2 * won[k] + 1), k))] += 1
        df = spark.createDataFrame([(0, k, float(v), seats) for k, v in votes.items()], "g int, k string, v double, seats int")
        got = {r.k: r.q for r in mixing.sainte_lague(df, ["g"], ["k"], "v", "seats", "q").collect()}
        assert got == {k: won[k] for k in votes}


def test_workers_give_memory_back():
    import numpy as np

    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096  # noqa: E731, SIM115
    blocks = [np.ones(20_000, np.uint8) for _ in range(5000)]
    last = blocks.pop()  # lies above the others
    del blocks
    before = resident()
    textbuf.forget()
    assert before - resident() > 50 << 20 and len(last)


def test_temporary_tables(spark, tmp_path):
    import os

    folder = textbuf.checkpoint_dir(spark).removeprefix("file:")

    def tables():
        return {x for x in os.listdir(folder) if x.startswith("table-")} if os.path.isdir(folder) else set()

    before = tables()
    with textbuf.temporary_tables(spark) as all_but_last:
        first = textbuf.stored(spark.range(5))
        textbuf.stored(first.filter("id > 1"))
        all_but_last()
        assert len(tables() - before) == 1
        last = textbuf.stored(spark.range(7))
    assert len(tables() - before) == 1 and last.count() == 7
    with pytest.raises(ValueError), textbuf.temporary_tables(spark):
        textbuf.stored(spark.range(5))
        raise ValueError
    assert len(tables() - before) == 1


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "sentencepiece"]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r.round_trip for r in rows)
    d = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, folder)
        assert sorted(d.columns) == sorted(docs.columns)
    assert d.filter(F.length("text") != F.col("n_chars")).count() == 0
