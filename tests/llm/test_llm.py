"""The training-data operators against brute force, exact round trips and edge cases."""

import collections
import hashlib
import pickle
import random
import re
import struct
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import public_tokenizers as PT
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siftloom.llm import arrow, bpe, lengths, licenses, media, mixing, simhash, substrings, toxicity, urls, vectors
from siftloom.llm import text as text_rules
from siftloom.llm.queries import VOCABULARY, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = bpe.read_ranks(open(PT.path(VOCABULARY), "rb").read())  # noqa: SIM115


def docs(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and blank texts, repeats, a long text, and a column whose name clashes."""
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "x", "a"), (4, "x", "a"), (None, "hello world again", "b"), (7, "word " * 30000, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("ids", F.lit(1)).withColumn("key", F.lit("k"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


# 6 -------------------------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken():
    ours, theirs = bpe.Codec(RANKS, PT.PATTERN), tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert PT.PATTERN == bpe.SPACE_FIRST
    r = random.Random(0)
    for n in range(3000):
        alphabet = r.choice(["abetionsr", " \n\t'sldvemREab1٣,.é　\x1c\x85\xa0", "aA ", "".join(map(chr, range(0x20, 0x2FFF, 7)))])
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert ours.encode(s) == theirs.encode_ordinary(s), repr(s)
        assert ours.decode(ours.encode(s)).decode() == s
        assert ours.count(s) == len(ours.encode(s))


def test_bpe_buffer():
    c, r = bpe.Codec(RANKS, PT.PATTERN), random.Random(1)
    b = bpe.Buffer(c)
    for _ in range(200):
        piece = bytes(r.choice(b"etaoinshrdlu ") for _ in range(r.randint(0, 5)))
        if r.random() < 0.5:
            b.append(piece)
        else:
            at = r.randint(0, len(b.data))
            b.edit(at, r.randint(0, len(b.data) - at), piece)
        assert b.ids() == c.encode_piece(b.data)
        cut = r.randint(0, len(b.data))
        assert b.ids(cut) == c.encode_piece(b.data[:cut])


def test_bpe_frames(spark, edge, nothing):
    v = vocabulary(spark)
    got = {(r.doc_id, r.n_tokens): r for r in bpe.round_trip(edge, v).collect()}
    assert len(bpe.round_trip(edge, v).collect()) == 7
    assert got[(1, 0)].ids_sha256 == hashlib.sha256(b"").hexdigest() == got[(2, 0)].decoded_sha256
    back = bpe.decode(bpe.encode(edge, v), v).join(edge.select("doc_id", "text"), "doc_id")
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bpe.round_trip(nothing, v).count() == 0
    both = bpe.encode(edge, v, exact="key")
    assert both.columns[-2:] == ["ids", "key"] and all(r.key for r in both.collect()) and both.count() == 7


# 10 ------------------------------------------------------------------------------------------------------------------


def test_lengths(spark, nothing):
    r = random.Random(2)
    n = [r.choice([0, 3, 1023, 1024, 5000, r.randint(0, 9000)]) for _ in range(300)]
    sums = lengths.suffix_sums(lengths.histogram(spark.createDataFrame([(x,) for x in n] + [(None,)], "n_tokens long")))
    rows = sums.collect()
    assert sorted(x.length for x in rows) == sorted(set(n))
    for x in rows:
        assert x.docs_ge == sum(v >= x.length for v in n) and x.tokens_ge == sum(v for v in n if v >= x.length)
        assert x.truncated_total == sum(min(v, x.length) for v in n)
        assert x.quantile == pytest.approx(sum(v <= x.length for v in n) / len(n))
    limits = spark.createDataFrame([(1,), (1500,), (99999,)], "context long")
    for x in lengths.at_limits(sums, limits).collect():
        assert x.truncated_total == sum(min(v, x.context) for v in n)
    assert lengths.suffix_sums(lengths.histogram(bpe.token_counts(nothing, vocabulary(spark)))).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in (None, "", " \n", "one", "One TWO", "a b c d É é", " ".join(words(500, 3)), "x\x1cy z\xa0q"):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("chunk", [20, 4096])
def test_simhash_links(spark, chunk):
    rng = random.Random(4)
    base, v = [rng.getrandbits(63) for _ in range(3)], set()
    for k in range(240):
        x = base[k % 3] if k % 4 else rng.getrandbits(63)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randint(0, 62)
        v.add(x)
    v = sorted(v)

    def comps(edges):
        p = {x: x for x in v}

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
        return {x: find(x) for x in v}

    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in v], "fp long"), 3, chunk).collect()]
    assert comps(got) == comps([(a, b) for i, a in enumerate(v) for b in v[:i] if bin(a ^ b).count("1") <= 3])


def shingles(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_similar_texts_against_brute_force(spark, edge, nothing):
    """Five-word shingles: pairs at a Jaccard similarity of 0.9 or more are linked, of those from 0.8 on most, and none below 0.6."""
    r, t = random.Random(80), []
    for i in range(60):
        w = words(300, 8000 + i)
        t.append(" ".join(w))
        for share in (0.002, 0.01, 0.02, 0.2):
            t.append(" ".join("new" if r.random() < share else x for x in w))
    sketched = simhash.sketches(docs(spark, t))
    for chunk in (simhash.CHUNK, 2):
        got = {x.doc_id: x.component_id for x in simhash.similar(sketched, chunk=chunk).collect()}
        s = [shingles(x) for x in t]
        n = {False: [], True: []}
        for i in range(0, len(t), 5):
            for a in range(i, i + 5):
                for b in range(a + 1, i + 5):
                    j = len(s[a] & s[b]) / len(s[a] | s[b])
                    if j >= 0.8:
                        n[j >= 0.9].append(got[a] == got[b])
        assert len(n[True]) > 100 and all(n[True]) and len(n[False]) > 30 and np.mean(n[False]) >= 0.7 and all(c // 5 == d // 5 for d, c in got.items())
        assert all(got[i + 4] == i + 4 for i in range(0, len(t), 5))
    rows = simhash.similar(simhash.sketches(edge)).collect()
    assert len(rows) == 7 and {x.component_id for x in rows if x.doc_id in (1, 2, 3)} == {1}
    assert simhash.similar(simhash.sketches(nothing)).count() == 0


def test_wide_planes():
    rng = np.random.RandomState(81)
    x, y = (rng.randint(0, 1 << 64, (130, 4), np.uint64) for _ in range(2))
    y[:100] = x[:100] ^ (np.uint64(1) << rng.randint(0, 64, (100, 4)).astype(np.uint64)) * (rng.random((100, 4)) < 0.7)
    far = np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(axis=2)
    for radius in (1, 2, 3, 36, 128, 140):
        assert (simhash.close_rows(x, y, radius) == (far <= radius)).all()
        assert (simhash.close_pairs(x, y, radius) == (np.diag(far) <= radius)).all()


def test_simhash_edges(spark, edge, nothing):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == 7
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert simhash.near_duplicates(nothing).count() == 0


# 5 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [16, 1024])
def test_vectors(spark, chunk):
    rng = np.random.RandomState(5)
    base = rng.standard_normal((6, 20))
    rows = [(i, int(i % 2), (base[i % 6] + rng.standard_normal(20) * rng.choice([0.0, 0.05, 0.2, 1.0])).tolist()) for i in range(150)]
    flat = np.zeros(20)
    flat[:2] = 0.98, np.sqrt(1 - 0.98**2)
    rows += [(300, 0, np.eye(20)[0].tolist()), (301, 0, flat.tolist()), (302, 0, (flat + np.eye(20)[1] * 1e-9).tolist()), (303, 0, (flat - np.eye(20)[1] * 1e-9).tolist())]  # at the threshold
    rows += [(200, 0, None), (201, 0, [0.0] * 20), (202, None, rows[0][2]), (203, 0, [float("nan")] * 20), (204, 0, rows[0][2]), (205, 0, rows[0][2][:5]), (206, 0, []), (207, 0, [x * 7 for x in rows[0][2]])]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"), chunk=chunk).collect()}
    assert len(got) == len(rows)
    ok = [(i, lab, np.array(e)) for i, lab, e in rows if e and lab is not None and np.isfinite(e).all() and np.abs(e).max() > 0]
    par = {r[0]: r[0] for r in rows}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    n = dict.fromkeys(par, 0)
    for i, a, x in ok:
        for j, b, y in ok:
            if i < j and a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                n[i], n[j] = n[i] + 1, n[j] + 1
                p, q = find(i), find(j)
                par[max(p, q)] = min(p, q)
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (n[k], find(k), find(k) == k) for k in par}


def test_vectors_repeated_keys_and_text_labels(spark):
    """Rows of one key with other vectors keep links of their own; labels may be text; columns that clash are not read."""
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, "a", v), (1, "a", w), (2, "a", v), (3, "a", w), (4, "a", w), (4, "a", w), (5, "b", v), (None, "a", v)]
    d = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").withColumn("gid", F.lit(1)).withColumn("n", F.lit("x"))
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(d).collect())
    assert got == [(-1, 0, None, False), (1, 1, 1, True), (1, 3, 1, True), (2, 1, 1, False), (3, 3, 1, False), (4, 3, 1, False), (4, 3, 1, False), (5, 0, 5, True)]


def test_vectors_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_pieces_share_the_tables_of_their_beginnings(monkeypatch):
    with open(PT.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    stem = "qvxzjkwqvxzjkw"
    pieces = [" " + stem + "xqjzvkw" * 9, *(f" {stem}{a}{b}" for a in "abcd" for b in "xyz"), " " + stem[:5], " é" + stem, " " + "zq" * 300]
    plain, small, codec = (bpe.Codec(ranks, PT.PATTERN, m) for m in (1, 0.0001, 1))
    want = []
    for piece in pieces:
        last = [-1]
        plain.fill(piece.encode(), last)
        want.append(plain.walk(piece.encode(), last))
    filled = []
    fill = codec._fill
    monkeypatch.setattr(codec, "_fill", lambda data, last, state: filled.append(len(data) + 1 - len(last)) or fill(data, last, state))
    for one in (small, codec):
        assert [one.encode_piece(p.encode()) for p in pieces] == want
    assert sum(filled[-999:]) < sum(len(p.encode()) for p in pieces) - 8 * 12
    marked = [f"{w}{m}" for w in ("word", "qvxzj", "é") for m in "'.,!?;:)/\"-" + "'s"] + ["a'", "a''", "it's", "x’", "a1.", "1.", "."]
    for word in marked:
        text = f"go {word} on"
        assert codec.encode(text) == [t for p in codec.split(text) for t in plain.encode_piece(p.encode())]



# 8 -------------------------------------------------------------------------------------------------------------------


def test_hashes_follow_words(monkeypatch):
    text = " a\tB b\x0b\n" + "\u00e9\u00c9\x1c\x85x " * 9 + "y" * 100 + " a  " + "z" * 30
    w = substrings.words(text)
    codes = {}
    for piece in (1 << 20, 16):
        monkeypatch.setattr(text_rules, "PIECE", piece)
        got = substrings.hashes(text).tolist()
        assert len(got) == len(w) and all(codes.setdefault(a, b) == b for a, b in zip(w, got, strict=True))
    assert len(set(codes.values())) == len(codes) and not len(substrings.hashes(None)) and not len(substrings.hashes("  "))


def test_passages(spark, nothing):
    p = words(70, 6)
    fuzzy = list(p)
    for i in (9, 31, 52):
        fuzzy[i] = "changed"
    junk = ["la"] * 80
    t = [words(90, 7) + p + words(40, 8), words(30, 9) + p + words(60, 10), words(200, 11), words(50, 12) + fuzzy, words(20, 13) + p[:30], junk + words(9, 14), words(9, 15) + junk, None, "", p]
    text = [x if x is None or isinstance(x, str) else " ".join(x) for x in t]
    found = substrings.passages(docs(spark, text)).collect()
    assert {r.doc_id for r in found} == {1, 3, 6, 9} and all(r.other_id < r.doc_id for r in found)
    assert {(1, 0), (3, 0), (6, 5), (9, 0)} <= {(r.doc_id, r.other_id) for r in found} and {r.other_id for r in found} <= {0, 1, 3, 5}
    one = next(r for r in found if r.doc_id == 1)
    assert (one.start, one.end, one.other_start, one.other_end, one.similarity) == (30, 100, 90, 160, 1.0)
    kept = {r.doc_id: r.text for r in substrings.drop_passages(docs(spark, text)).collect()}
    assert set(kept) == set(range(9)) and kept[2] == text[2] and kept[1].split() == t[1][:30] + t[1][100:] and kept[0] == text[0]
    assert substrings.passages(nothing).count() == 0 and substrings.drop_passages(nothing).count() == 0


def test_many_copies_over_partitions(spark):
    p = " ".join(words(80, 16))
    d = docs(spark, [f"{' '.join(words(20, 100 + i))} {p} {' '.join(words(10, 900 + i))}" for i in range(120)])
    found = substrings.passages(d.repartition(7)).collect()
    assert {r.doc_id for r in found} == set(range(1, 120)) == {r.doc_id for r in found if r.other_id == 0}
    got = {(r.doc_id, r.other_id): r for r in found if r.other_id}
    assert got.keys() >= {(i, i - 1) for i in range(2, 120)}  # and the document before
    assert all(r.other_id == r.doc_id - 1 or (r.similarity == 1 and r.end - r.start >= 50) for r in got.values())  # a chance word more
    again = substrings.passages(d.repartition(2)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


@pytest.mark.parametrize("every, length, least", [(6, 120, 0.95), (7, 120, 0.95), (8, 60, 0.9), (10, 60, 0.95)])
def test_recall_of_edited_passages(spark, every, length, least):
    """Passages of which every n-th word was changed (similarity 1 - 1 / n), each against its original."""
    t = []
    for i in range(40):
        p = words(length, 5000 + 7 * i)
        t += [words(30, 6000 + i) + p + words(20, 6100 + i), words(25, 6200 + i) + [f"zz{j}" if j % every == i % every else w for j, w in enumerate(p)] + words(35, 6300 + i)]
    found = substrings.passages(docs(spark, [" ".join(x) for x in t])).collect()
    hit = {r.doc_id for r in found if r.other_id == r.doc_id - 1 and r.end - r.start >= 0.7 * length}
    assert len(hit & set(range(1, 80, 2))) >= least * 40
    assert all(r.doc_id % 2 and r.similarity >= 0.8 for r in found)


def test_recall_against_brute_force(spark):
    """Random edits at 5 to 15 words in 100, and parts of the passage in other documents before and between."""
    r, t, want = random.Random(70), [], []
    for i in range(30):
        p = words(90, 7000 + i)
        edit = lambda w: [x for x in (r.choice(["", "new", v]) if r.random() < 0.15 else v for v in w) if x]
        first = len(t)
        t += [words(20, 7100 + i) + p[:40], p[30:70] + words(20, 7200 + i), words(15, 7300 + i) + p + words(15, 7400 + i), words(10, 7500 + i) + p[50:], words(20, 7600 + i) + edit(p) + words(9, 7700 + i)]
        a, b = t[first + 2], t[first + 4]
        if any(e - s >= 60 for s, e, *_ in substrings.segments(*substrings.align(b, a), 50, 0.8)):
            want.append((first + 4, first + 2))
    got = {(x.doc_id, x.other_id) for x in substrings.passages(docs(spark, [" ".join(x) for x in t])).collect()}
    assert len(want) >= 25 and len(got & set(want)) >= 0.9 * len(want)


def test_edited_passages_whatever_holds_their_parts(spark):
    """Every part of an edited passage is in an earlier document and again in one between; verbatim runs hold it in part, too."""
    t, want = [], set()
    for i in range(12):
        p = words(75, 8000 + i)
        every, where = 5 + i % 4, i % 3
        own = [f"zz{j}" if j % every == every - 1 else w for j, w in enumerate(p)]
        parts = [own[j : j + every - 1] for j in range(0, 75, every)]
        beside = lambda k: [words(30, 20_000 + 1000 * i + 40 * k + j) + q + words(30, 60_000 + 1000 * i + 40 * k + j) for j, q in enumerate(parts)]  # noqa: B023, E731
        t += beside(0) + [words(20, 8100 + i) + p + words(15, 8200 + i)]
        want.add((len(t) + len(parts), len(t) - 1))
        t += [*beside(1), words(25, 8300 + i) * (where != 1) + own + words(35, 8400 + i) * (where != 2)]
    d = docs(spark, [" ".join(x) for x in t])
    found = substrings.passages(d.repartition(5)).collect()
    assert {(r.doc_id, r.other_id) for r in found if r.end - r.start >= 70} == want
    for r in found:
        ai, _ = substrings.align(t[r.doc_id][r.start : r.end], t[r.other_id][r.other_start : r.other_end])
        assert len(ai) >= 0.8 * max(r.end - r.start, r.other_end - r.other_start) - 1e-6
    left = {r.doc_id: len(r.text.split()) for r in substrings.drop_passages(d).collect()}
    assert all(left.get(doc, 0) <= len(t[doc]) - 70 for doc, _ in want)


def test_packed_grams_come_back():
    r = np.random.RandomState(86)
    n = 500
    docs = np.unique(r.randint(-(1 << 62), 1 << 62, (40, 2)), axis=0)
    rows = (r.randint(0, 40, n), r.randint(0, 1 << 48, n).astype(np.uint64), r.randint(0, 70_000, n), r.randint(-2, 9, n))
    packed = [substrings._pack(np.arange(7), rows[1][part] % np.uint64(7), docs, *(v[part] for v in rows)) for part in (slice(0, 260), slice(260, n))]
    own, *got = substrings._unpack(packed)
    want = sorted((*docs[d].tolist(), int(h), p, x) for d, h, p, x in zip(*rows, strict=True))
    assert sorted((*own[d].tolist(), int(h), p, x) for d, h, p, x in zip(*(v.tolist() for v in got), strict=True)) == want
    assert substrings._unpack([]) is None


def test_shared_grams_leave_in_parts(monkeypatch):
    """A partition's shared k-mers leave in bounded parts, by document and position, and none is lost."""
    monkeypatch.setattr(substrings, "PACK", 50)
    r, keys = np.random.RandomState(90), np.arange(3)
    names = np.stack([np.arange(20), r.randint(-(1 << 62), 1 << 62, 20)], 1)
    d, k, p = r.randint(0, 20, 600), r.randint(0, 150, 600).astype(np.uint64), r.randint(0, 9000, 600)
    out = list(substrings._shared(keys)(iter([substrings._pack(keys, k * 0, names, d, k, p, p * 0)])))
    own, doc, h, pos, x = substrings._unpack(out)
    of = {v: [int(a) for a, b in zip(d, k, strict=True) if b == v] for v in k}
    want = sorted((*names[a].tolist(), int(b), int(c), len(of[b])) for a, b, c in zip(d, k, p, strict=True) if len(set(of[b])) > 1)
    assert sorted((*own[a].tolist(), *map(int, row)) for a, *row in zip(doc, h, pos, x, strict=True)) == want
    assert max(len(v) // 8 for b in out for v in b.column("h").to_pylist()) <= 50 < len(want)


def test_rare_grams_equal_brute_force():
    """A k-mer is chosen if it is among the least frequent of some window that has enough of them and is not known."""
    r = random.Random(85)
    for _ in range(60):
        n, reach, shared = r.randint(1, 90), r.choice([12, 20]), r.choice([3, 8])
        size, most = reach - substrings.GRAM + 1, max(shared - substrings.SHARED, 0)
        pos = sorted(r.sample(range(n), r.randint(1, n)))
        kinds = {p: r.randint(1, 30) for p in pos}
        count = {p: 2 + kinds[p] % 7 for p in pos}
        covered = [(s, s + r.randint(1, 40), r.random() < 0.5) for s in r.sample(range(n), min(n, 3))]
        words_of = lambda p: range(p, p + substrings.GRAM)
        free = [p for p in pos if not any(v and s <= p and p + substrings.GRAM <= e for s, e, v in covered)]
        fresh = {p for p in free if any(not any(s <= x < e for s, e, _ in covered) for x in words_of(p))}
        want = dict.fromkeys(pos, 0)
        for w in range(max(max(pos) + 1 - size, 0) + 1):
            own = [p for p in free if w <= p < w + size]
            for p in own if len(own) >= shared else []:
                if sum((count[q], kinds[q]) >= (count[p], kinds[p]) for q in own) > most:
                    want[p] = max(want[p], 2 if fresh & set(own) else 1)
        got = substrings._rare(np.array([kinds[p] for p in pos], np.uint64), np.array(pos, np.int32), np.array([count[p] for p in pos], np.int32), covered, reach, shared)
        assert got.tolist() == [want[p] for p in pos]


@pytest.mark.parametrize("held", [1 << 20, 40])
def test_spots_equal_brute_force(monkeypatch, held):
    """Every k-mer that looks for others meets all of earlier documents; spots are where enough of them lie close together."""
    monkeypatch.setattr(substrings, "BATCH", held)
    r, reach, shared, keys = random.Random(87), 12, 8, np.arange(3)
    for _ in range(25):
        names = np.array(sorted((r.randint(-9, 9), r.randint(-(1 << 62), 1 << 62)) for _ in range(r.randint(2, 7))))
        line = [r.randint(1, 30) for _ in range(15)]
        rows = [(d, k, p, r.choice([1, 2, 2])) for d in range(len(names)) for p, k in enumerate(r.choice(line) if r.random() < 0.2 else line[v % 15] for v in range(r.randint(0, 60))) if r.random() < 0.8]
        want = set()
        for d, o in ((d, o) for d in range(len(names)) for o in range(d)):
            matches = [(p, q) for e, k, p, x in rows for f, g, q, _ in rows if (e, f) == (d, o) and k == g and x == 2]
            bands = {(q - p) // reach for p, q in matches}
            for band in bands:
                own = [(p, q) for p, q in matches if (q - p) // reach in (band, band + 1)]
                at = sorted({p for p, _ in own})
                near = sorted({p for i in range(len(at) - substrings.SHARED + 1) if at[i + substrings.SHARED - 1] - at[i] < reach for p in at[i : i + substrings.SHARED]})
                cuts = [0, *(i for i in range(1, len(near)) if near[i] - near[i - 1] >= reach), len(near)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a < b:
                        q = [q for p, q in own if near[a] <= p <= near[b - 1]]
                        want.add((*names[d].tolist(), *names[o].tolist(), near[a], near[b - 1] + substrings.GRAM, min(q), max(q) + substrings.GRAM))
        d, k, p, x = (np.array(v) for v in zip(*rows, strict=True)) if rows else (np.zeros(0, int),) * 4
        packed = [substrings._pack(keys, k.astype(np.uint64) * 0, names, d, k.astype(np.uint64), p, x)] if rows else []
        meets = list(substrings._partners(keys)(iter(packed)))
        # by partition, as the shuffle deals them
        dealt = [[b.filter(pa.compute.equal(b.column("b"), int(key))) for b in meets] for key in keys]
        got = [b for part in dealt for b in substrings._spots(reach, shared)(iter([b for b in part if b.num_rows]))]
        assert sorted(tuple(v.values()) for b in got for v in b.to_pylist()) == sorted(want)


def _spots_of(t: list[list[int]], reach: int, shared: int) -> list[dict]:
    """Spots of documents given as k-mers by position, by all steps of the second round."""
    keys, names = np.arange(1), np.array([[i, 7 * i] for i in range(len(t))])
    d, p = np.repeat(np.arange(len(t)), [len(x) for x in t]), np.concatenate([np.arange(len(x)) for x in t])
    every = substrings._pack(keys, p * 0, names, d, np.concatenate(t).astype(np.uint64), p, p * 0)
    chosen = list(substrings._chosen(keys, reach, shared)(substrings._shared(keys)(iter([every]))))
    return [r for b in substrings._spots(reach, shared)(substrings._partners(keys)(iter(chosen))) for r in b.to_pylist()]


def test_short_runs_of_one_word_are_no_spots():
    """13 3-word shingles of one word are too few of the 18 that must meet, if a window holds no more frequent ones; 30 are enough."""
    r = random.Random(91)

    def pairs(*sizes: int) -> set[tuple[int, int]]:
        rest = [[r.randint(100, 1 << 40) for _ in range(140)] for _ in sizes]
        pool = sum(rest, [])  # document 0, so that other shingles are shared as well
        r.shuffle(pool)
        t = [pool, *(x[:70] + [5] * n + x[70:] for x, n in zip(rest, sizes, strict=True))]
        return {(x["doc_id"], x["adoc"]) for x in _spots_of(t, 62, 18) if x["adoc"]}

    assert not pairs(*[13] * 8)  # a spot for each pair before
    assert not pairs(*[13] * 8, 30)  # as many positions, but the other side has no room
    assert pairs(*[30] * 8) == {(i, j) for i in range(1, 9) for j in range(1, i)}


def test_windows_that_share_enough_are_spots():
    """Whatever else documents hold, two windows that share ``shared`` k-mers in order give a spot there."""
    r, reach, shared = random.Random(92), 22, 10
    met = 0
    for _ in range(60):
        often = lambda: r.choice([1, 1, 1, 2, 2, 3, 4]) if r.random() < 0.5 else r.randint(5, 60)  # noqa: B023, E731
        t = [[often() for _ in range(r.randint(30, 90))] for _ in range(6)]
        for d in range(1, 6):  # a window of an earlier document, with edits
            a = t[r.randrange(d)]
            at, n, own = r.randrange(len(a) - 20), 20, r.randrange(len(t[d]) - 20)
            t[d][own : own + n] = [often() if r.random() < 0.4 else k for k in a[at : at + n]]
        got = collections.defaultdict(list)
        for x in _spots_of(t, reach, shared):
            got[x["doc_id"], x["adoc"]].append((x["s"], x["e"]))
        for d, o in ((d, o) for d in range(6) for o in range(d)):
            for p, q in ((p, q) for p in range(len(t[d]) - 19) for q in range(len(t[o]) - 19)):
                if sum(x == y for x, y in zip(t[d][p : p + 20], t[o][q : q + 20], strict=True)) >= shared:
                    met += 1
                    assert any(s < p + 20 + 2 and p < e for s, e in got[d, o]), (d, o, p, q)
    assert met > 300


def test_first_round_frees_its_seeds(spark, monkeypatch):
    """Seeds go to their matches by halves, and are gone when the matches are dealt out to be chained."""
    import os

    made, there = [], []
    real = substrings.materialize

    def stored(df, tag, *more):
        there.append((tag, [t for t, x in made if os.path.exists(x)]))
        out = real(df, tag, *more)
        made.append((tag, out._siftloom_path.removeprefix("file://")))
        return out

    monkeypatch.setattr(substrings, "materialize", stored)
    p = words(80, 93)
    found = substrings.passages(docs(spark, [" ".join(words(30, 94) + p), " ".join([*p[:40], "x", *p[41:]]), " ".join(p)])).collect()
    assert {(1, 0), (2, 0)} <= {(r.doc_id, r.other_id) for r in found}
    at = dict(there)["chains"]
    assert "seeds" not in at and at.count("matches") == 2  # before: the seeds and one table of all matches


def test_repeats_travel_as_positions():
    """A k-mer that two documents repeat n and m times travels as n + m positions, not as n m matches."""
    n, m = 300, 400
    names = np.array([[1, 1], [2, 2]])
    d = np.r_[np.zeros(m, int), np.ones(n, int)]
    packed = substrings._pack(np.arange(1), np.zeros(n + m, np.uint64), names, d, np.full(n + m, 7, np.uint64), np.r_[np.arange(m), np.arange(n)], np.full(n + m, 2))
    meets = list(substrings._partners(np.arange(1))(iter([packed])))
    assert sum(b.num_rows for b in meets) == 1 and sum(b.nbytes for b in meets) < 10 * (n + m)


def test_release_frees_shuffles(spark, tmp_path):
    """When it returns, the shuffle files of a finished job are gone."""
    from siftloom.session import release

    def held() -> set[str]:
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(files.length()) if (f := files.apply(i).getName()).startswith("shuffle_")}

    release(spark)
    before = held()
    spark.range(1000).repartition(3, "id").mapInArrow(lambda x: x, "id long").write.parquet(str(tmp_path / "x"))
    assert held() - before
    release(spark)
    assert not held() - before


def test_spots_that_begin_alike(spark):
    """Two spots of one pair with the same beginnings are aligned each on its own, whatever the order of rows."""
    p = words(120, 88)
    d = substrings._keyed(docs(spark, [" ".join(p + words(90, 89)), " ".join(p)]), "doc_id", "text").cache()
    th = {r.doc_id: r.th for r in d.collect()}
    spots = [(1, th[1], 0, th[0], 0, 60, 0, 60), (1, th[1], 0, th[0], 0, 120, 0, 120), (1, th[1], 0, th[0], 0, 120, 0, 190)]
    kinds = "doc_id long, th long, adoc long, ath long, s int, e int, os int, oe int"
    found = [sorted((r.end, r.other_end) for r in substrings._aligned(d, spark.createDataFrame(x, kinds), 50, 0.8, 0).collect()) for x in (spots, spots[::-1])]
    assert found[0] == found[1] == [(60, 60), (120, 120), (120, 120)]


def brute_common(x, y):
    n = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, v in enumerate(x):
        for j, w in enumerate(y):
            n[i + 1][j + 1] = n[i][j] + 1 if v == w else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


@pytest.mark.parametrize("bits", [1 << 29, 40])
def test_align_is_longest(monkeypatch, bits):
    monkeypatch.setattr(substrings, "LCS_BITS", bits)
    r = random.Random(71)
    for _ in range(300):
        x, y = ([r.choice("abcde"[: r.randint(1, 5)]) for _ in range(r.randint(0, 30))] for _ in range(2))
        ai, bi = substrings.align(x, y)
        assert [x[i] for i in ai] == [y[j] for j in bi] and ai == sorted(set(ai)) and bi == sorted(set(bi))
        assert len(ai) == brute_common(x, y)


def test_passages_edges(spark, edge):
    """Repeated rows are one document; null keys and columns that clash take no part."""
    p = " ".join(words(60, 72))
    d = spark.createDataFrame([(None, p), (5, p), (5, p), (6, p + " x"), (6, "y " + p)], "doc_id long, text string")
    d = d.withColumn("h", F.lit(1)).withColumn("start", F.lit("s")).withColumn("n_chars", F.length("text"))
    assert {(r.doc_id, r.other_id) for r in substrings.passages(d).collect()} == {(6, 5), (6, 6)}
    left = substrings.drop_passages(d)
    assert left.columns == d.columns and sorted((r.doc_id or 0, r.text.strip()) for r in left.collect()) == [(0, p), (5, p), (5, p), (6, "x"), (6, "y")]
    assert substrings.passages(edge).count() == 0 and substrings.drop_passages(edge).count() == 7


def test_exact_repeats_equal_brute_force(spark):
    """Words in a run of 50 words that an earlier document holds are reported, whatever its parts occur in before, but for
    fewer than five words next to a passage of the same two documents."""
    r, p = random.Random(60), words(60, 61)
    t = [p[:40] + words(70, 62), words(30, 63) + p[24:], words(20, 64) + p + words(25, 65), words(33, 66) + p + words(8, 67)]
    pool = [words(r.randint(8, 90), 700 + i) for i in range(12)]
    for i in range(60):
        own: list = []
        while len(own) < 150:
            q = r.choice(pool)
            a = r.randrange(len(q) // 2)
            own += q[a : r.randint(a + 1, len(q))] if r.random() < 0.7 else words(r.randint(1, 12), 800 + 40 * i + len(own))
        t.append(own)
    t += [["la"] * 130, words(3, 68) + ["la"] * 90, t[9][:49], t[9][1:51], p[:50], p[10:60]]
    found = substrings.passages(docs(spark, [" ".join(x) for x in t])).collect()
    got: dict = {}
    for x in found:
        assert x.other_id < x.doc_id
        got.setdefault(x.doc_id, set()).update(range(x.start, x.end))
    seen: set = set()
    for i, w in enumerate(t):
        own = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        want = {v for j, g in enumerate(own) if g in seen for v in range(j, j + 50)}
        left = want - got.get(i, set())
        assert not any(left >= set(range(v, v + 5)) for v in left), i
        seen.update(own)
    assert any(x.doc_id == 3 and x.other_id == 2 and x.end - x.start >= 60 for x in found)


def test_chains_prefer_order():
    x, y = [0, 5, 10, 15, 40], [100, 105, 3, 115, 140]
    assert substrings.chains(x, y, gap=0.25)[0] == [0, 1, 3]
    best = substrings.chains(list(range(0, 50, 5)), list(range(7, 57, 5)))
    assert best == [list(range(10))]


# 1 -------------------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([10, 1000, 1000], [5, 2, 1], 2010) == pytest.approx([30, 1320, 660])
    assert mixing.targets([], [], 0) == [] and mixing.targets([0], [5], 0) == [0.0]


def test_level_equals_targets(spark):
    r = random.Random(90)
    for _ in range(6):
        sizes = [r.choice([0, 1, 5, 100, r.randint(0, 5000)]) for _ in range(r.randint(1, 40))]
        w = [float(mixing.WEIGHTS[i % 3]) for i in range(len(sizes))]
        left, share = mixing.level(spark.createDataFrame(list(zip(sizes, w, strict=True)), "source_size long, weight double"), 3.0)
        got = [min(left * v / share, 3.0 * n) if share > 0 else 3.0 * n for n, v in zip(sizes, w, strict=True)]
        assert got == pytest.approx(mixing.targets(sizes, w, sum(sizes)))


def test_landing_is_nearest():
    r = random.Random(91)
    for _ in range(40):
        units = [[r.random(), r.randint(0, 50), i] for i in range(r.randint(1, 9))]
        got = mixing.land(units)
        goal, docs_ = sum(p * s for p, s, _ in units), sum(p for p, *_ in units)
        error = lambda c: abs(sum(v * u[1] for v, u in zip(c, units, strict=True)) - goal) + 0.01 * (np.mean([u[1] for u in units]) or 1) * abs(sum(c) - docs_)
        assert error([v for _, v in got]) == pytest.approx(min(error([k >> i & 1 for i in range(len(units))]) for k in range(1 << len(units))))
    assert mixing.land([]) == [] and mixing.ladder([]) == set() and mixing.ladder([9, 8, 6, 3, 1, 0], 3) == {0, 2, 3}


def test_small_sources_come_near(spark):
    """Ten documents of mixed sizes a source: the taken words are the nearest that whole documents allow."""
    r = random.Random(92)
    d = docs(spark, [" ".join(words(r.choice([3, 20, 150, 900]), 9000 + i)) for i in range(60)], lambda i: f"s{i % 6}")
    rows = mixing.mix(d.withColumns({c: F.lit(c) for c in ("size", "target", "copies", "rank", "dup")})).collect()
    for s in range(6):
        own = [x for x in rows if x.source_rank == s]
        low = min(x.copies for x in own) if len({x.copies for x in own}) > 1 else int(own[0].target / own[0].source_size)
        best = min(abs(sum(x.size * (low + (k >> i & 1)) for i, x in enumerate(own)) - own[0].target) for k in range(1 << len(own)))
        assert abs(sum(x.taken for x in own) - own[0].target) <= best + 0.01 * own[0].target
    same = spark.createDataFrame([(1, "a b c", "x")] * 5000 + [(2, "d " * 900, "y")], "doc_id long, text string, source string")
    got = mixing.mix(same, block_rows=64).collect()
    assert len(got) == 5001 and {x.copies for x in got if x.doc_id == 1} <= {0, 1, 2, 3}
    assert sum(x.taken for x in got if x.doc_id == 1) == pytest.approx(next(x.target for x in got if x.doc_id == 1), abs=3)


def test_mix(spark, edge, nothing):
    r = random.Random(17)
    d = docs(spark, [" ".join(words(r.randint(1, 60), 1000 + i)) for i in range(900)])
    rows = mixing.mix(d, block_rows=64).collect()
    assert len(rows) == 900 and all(0 <= x.taken <= 3 * x.size and x.taken == x.size * x.copies for x in rows)
    for s in range(3):
        own = [x for x in rows if x.source_rank == s]
        assert sum(x.size for x in own) == own[0].source_size
        assert sum(x.taken for x in own) == pytest.approx(own[0].target, rel=0.01)
        assert sum(x.copies for x in own) == pytest.approx(len(own) * own[0].target / own[0].source_size, abs=3)
    again = mixing.mix(d.repartition(9), block_rows=64).collect()
    assert {x.doc_id: x.taken for x in again} == {x.doc_id: x.taken for x in rows}
    assert len(mixing.mix(edge).collect()) == 7 and mixing.mix(nothing).count() == 0


# 2 -------------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, edge, nothing):
    r = random.Random(18)
    vocab = words(400, 19)
    texts, y = [], []
    for _ in range(1200):
        toxic = r.random() < 0.2
        t = [r.choice(vocab) for _ in range(r.randint(20, 80))]
        if toxic:
            for w in r.sample(["zzbad", "zzworse", "zzworst"], 2):
                t.insert(r.randint(0, len(t)), w.upper() + ",")
        texts.append(" ".join(t))
        y.append(int(toxic))
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1 - v, v) for i, v in enumerate(y) if i < 800], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(d, labels)
    got = {x.doc_id: x.rejected for x in toxicity.score(d, chain).collect()}
    assert np.mean([got[i] == bool(y[i]) for i in range(800, 1200)]) > 0.97  # held out
    assert chain.extra[1] and chain.oof.shape == (800, 2)
    assert len(toxicity.score(edge, chain).collect()) == 7 and toxicity.score(nothing, chain).count() == 0
    none = toxicity.fit_chain(nothing, labels)
    assert not any(x.rejected for x in toxicity.score(d, none).collect())


def test_toxicity_needs_evidence(spark):
    """Labels that the words do not explain, or too few of them, reject nothing."""
    d = docs(spark, [" ".join(words(40, 3600 + i)) for i in range(200)])
    for n in (87, 8):
        labels = spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
        chain = toxicity.fit_chain(d, labels)
        assert chain.threshold[1] == 2.0 and not any(x.rejected for x in toxicity.score(d, chain).collect())
    assert toxicity.tells(40, 45, 50, 1000) and not toxicity.tells(5, 45, 50, 1000) and not toxicity.tells(50, 1000, 50, 1000)


def test_toxicity_trains_on_each_chosen_key(spark):
    rows = [(0, " ".join(words(20, 3000 + i))) for i in range(300)] + [(i, " ".join(words(20, 4000 + i))) for i in range(1, 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    one, two = (toxicity.fit_chain(x, labels, max_train=12) for x in (d, d.orderBy(F.desc("text")).repartition(5)))
    assert one.oof.shape == (12, 2) and one.words.keys() == two.words.keys() and one.threshold == pytest.approx(two.threshold)


# 3 -------------------------------------------------------------------------------------------------------------------


def test_licenses(spark, edge, nothing):
    own = "Copyright (c) 2020 Someone\n\n" + licenses.MIT.replace("sublicense", "sub-license").upper().replace("\n", "\n\n  ")
    d = docs(spark, [own, "text\nReleased under the MIT Licence\nmore", "MIT", None, "", "SPDX-License-Identifier: ISC"])
    got = {r.doc_id: (r.license, r.line_licenses, r.n_lines) for r in licenses.scan(d).collect()}
    assert got[0] == ("MIT", "", 0) and got[1] == (None, "MIT", 1) and got[2] == got[3] == got[4] == (None, "", 0) and got[5] == ("ISC", "ISC", 1)
    pdf = d.toPandas()  # noqa: F841
    want = {r[0]: r[2:] for r in duckdb.sql(licenses.sql().replace("from documents", "from pdf")).fetchall()}
    assert want == got
    assert len(licenses.scan(edge).collect()) == 7 and licenses.scan(nothing).count() == 0


def test_licenses_in_any_wrapping(spark):
    """Every known whole text is found at any line width, with copyright lines of all kinds; body lines are kept."""
    whole = [(n, t) for n, t in licenses.KNOWN if len(t) > 300]
    lines = ["Copyright (c) 2020 Someone", "Copyright Jane Doe and others. All rights", "reserved.", "(C) 1999 A. Holder", "© The Authors", "# copyright 2001-2003 x"]
    rows, want = [], []
    for k, (name, text) in enumerate(whole):
        for width in range(40, 101, 4 + k % 3):
            rows.append("\n\n".join([lines[width % 2 * 3] if width % 5 else "\n".join(lines), *(textwrap.fill(x, width, break_on_hyphens=False) for x in text.split("\n"))]))
            want.append(name)
    rows += [licenses.MIT.replace("The above copyright notice", "Copyright notice"), "The parts\ncopyright is held by\n(c) You must retain this"]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in licenses.scan(d).collect()}
    assert [got[i].license for i in range(len(want))] == want
    assert got[len(want)].license is None
    pdf = d.toPandas()  # noqa: F841
    theirs = {r[0]: r[1:] for r in duckdb.sql(licenses.sql().replace("from documents", "from pdf")).fetchall()}
    assert theirs == {k: tuple(r)[1:] for k, r in got.items()}


# 7 -------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [(1, "http://a.example.org/es/1?q"), (2, "https://EXAMPLE.org/en/12#x"), (3, "http://x.com/fr/"), (4, "http://x.com/de/1"), (5, None), (6, "nothing"), (7, "http://notorg/x"), (8, "http://a.org"), (9, "http://x.net/a/b?c"), (9, "http://x.net/a/b?c")]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(d).collect()}
    rule = {k: (r.rule, r.verdict) for k, r in got.items() if r.rule}
    assert rule == {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("com/fr/", "allow"), 4: ("com/de/", "block")}
    assert (got[2].host, got[2].path) == ("example.org", "/en/12") and (got[5].host, got[5].path) == ("", "") == (got[6].host, got[6].path)
    assert got[8].rule is None and got[9].path == "/a/b" and len(urls.judge(d).collect()) == 10
    assert urls.judge(d.limit(0)).count() == 0


def brute_scores(rows):
    """Witten-Bell models by dictionaries: held-out and full scores of (url, class or None, rows)."""
    fold = {}

    def model(kind, without):
        n = {}
        for url, good, m in rows:
            if good == kind and fold[url] != without:
                b = bytes(urls.ORDER) + url.encode()
                for i in range(urls.ORDER, len(b)):
                    for o in range(urls.ORDER + 1):
                        at = n.setdefault(b[i - o : i], {})
                        at[b[i]] = at.get(b[i], 0) + m
        return n

    def p(n, ctx, c):
        low = p(n, ctx[1:], c) if ctx else 1 / 256
        here = n.get(ctx)
        return (here.get(c, 0) + len(here) * low) / (sum(here.values()) + len(here)) if here else low

    def score(url, good, bad):
        b = bytes(urls.ORDER) + url.encode()
        return sum(np.log(p(good, b[i - urls.ORDER : i], b[i]) / p(bad, b[i - urls.ORDER : i], b[i])) for i in range(urls.ORDER, len(b))) / max(len(b) - urls.ORDER, 1)

    return fold, model, score


def test_url_models_against_brute_force(spark):
    r = random.Random(95)
    every = [f"http://{r.choice(['a.org', 'b.org', 'x.com/de', 'y.com/de', 'q.net', 'ü.net'])}/{r.choice(['buy', 'read', 'É', 'win'])}{r.choice(['', '/now', '?x=1'])}{r.randint(0, 3)}" for _ in range(60)] + ["", None, "http://p.net/" + "z" * 3000]
    d = spark.createDataFrame(list(enumerate(every)), "page_id long, url string").withColumn("gram", F.lit("clash")).withColumn("score", F.lit(1))
    got = {x.page_id: x for x in urls.judge(d).collect()}
    assert len(got) == len(every)
    count: dict = {}
    for i, u in enumerate(every):
        v = {"allow": 1, "block": 0}[got[i].verdict] if got[i].rule else None
        count[u or ""] = (v, count.get(u or "", (v, 0))[1] + 1)
    rows = [(u, v, m) for u, (v, m) in count.items()]
    fold, model, score = brute_scores(rows)
    fold.update({u: spark.range(1).select(F.pmod(F.xxhash64(F.lit(u)), F.lit(urls.FOLDS))).first()[0] for u, *_ in rows if count[u][0] is not None})
    good, bad = model(1, None), model(0, None)
    for i, u in enumerate(every):
        assert got[i].score == pytest.approx(score(u or "", good, bad), abs=2e-8), u
    held = [(score(u, model(1, fold[u]), model(0, fold[u])), v, m) for u, v, m in rows if v is not None]
    assert {v for _, v, _ in held} == {0, 1}
    right = lambda t: sum(m for s, v, m in held if v and s >= t) / sum(m for _, v, m in held if v) + sum(m for s, v, m in held if not v and s < t) / sum(m for _, v, m in held if not v)
    marks = [got[i] for i in range(len(every)) if not got[i].rule]
    allowed, blocked = [x.score for x in marks if x.verdict == "allow"], [x.score for x in marks if x.verdict == "block"]
    assert marks and (not allowed or not blocked or min(allowed) > max(blocked))
    parts = urls.scores(spark.createDataFrame([(i, u, len(u.encode()), m, -1 if v is None else v * urls.FOLDS + fold[u]) for i, (u, v, m) in enumerate(rows)], "uid long, url string, size int, m long, g int"))
    steps = [k * 8 / urls.BINS - 4 for k in range(urls.BINS + 1)]
    assert right(parts[1]) >= max(map(right, steps)) - 1e-9
    assert all((x.verdict == "allow") == (x.score >= parts[1]) for x in marks)


def test_url_verdicts_follow_the_models(spark):
    """URLs without a rule that look like accepted ones are allowed, those that look like rejected ones are blocked."""
    r = random.Random(96)
    good, bad = [f"essay-{r.choice(['river', 'stone', 'bread'])}-{i}" for i in range(150)], [f"cheap_pills_{r.choice(['now', 'win', 'bet'])}{i}" for i in range(150)]
    rows = [f"http://a.org/{x}" for x in good[:100]] + [f"http://s.com/de/{x}" for x in bad[:100]] + [f"http://n.net/{x}" for x in good[100:]] + [f"http://n.net/{x}" for x in bad[100:]]
    got = {x.page_id: x.verdict for x in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
    assert np.mean([got[i] == "allow" for i in range(200, 250)]) > 0.95 and np.mean([got[i] == "block" for i in range(250, 300)]) > 0.95


# 9 -------------------------------------------------------------------------------------------------------------------


def test_media(spark, edge, nothing, tmp_path):
    got = media.media_columns(edge).collect()
    assert len(got) == 7
    text = {1: "", 2: "", 3: " \n\t ", 4: "x", 7: "word " * 30000, None: "hello world again"}
    for r in got:
        p, n = media.payload_of(text[r.doc_id])
        w = media.to_wav(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(w), hashlib.sha256(w).hexdigest())
        assert len(p) % 576 == 0 and p
    assert media.media_columns(nothing).count() == 0
    archives = media.write_archives(edge, str(tmp_path / "a"), roll_bytes=1000)
    assert archives.count() >= 2
    small = media.read_archives(spark, archives, split_bytes=700, batch_bytes=10)
    assert small.count() == 7 and small.select("archive", "offset").distinct().count() == 7
    spark.dataSource.register(media.ArchiveSource)
    assert spark.read.format("media_archive").load(str(tmp_path / "a")).count() == 7


def test_media_against_brute_force(spark):
    """Every column from the contract's words, without the module's functions."""
    texts = ["", None, "x", "a" * 576, "b" * 577, "é" * 300, " ".join(words(800, 97)), "word " * 30000]
    for r in media.media_columns(docs(spark, texts)).collect():
        raw = (texts[r.doc_id] or "").encode()
        pay = raw
        while not pay or len(pay) % 576:
            pay += b"\xff"
        wav = b"RIFF" + struct.pack("<I", 36 + len(pay)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(pay)) + pay
        means = [np.mean(list(pay[len(pay) * k // 64 : len(pay) * (k + 1) // 64])) for k in range(64)]
        bits = "".join("1" if m > np.median(means) else "0" for m in means)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(wav), hashlib.sha256(wav).hexdigest(), f"{int(bits, 2):016x}")


def test_member_is_read_again(tmp_path):
    """A read that fails once is tried anew by the member's own offset; the others are not touched."""
    out = media._Out(str(tmp_path))
    for i in range(3):
        out.add(i, 5, media.to_wav(random.Random(i).randbytes(576)))
    uri, size, _ = out.close()
    reader = media._Reader({"archives": f"{uri}\t{size}", "retries": "2"})
    fs, path = media._open(uri)
    tries = []

    class Failing:
        def seek(self, at):
            tries.append(at)
            raise OSError("lost")

    with fs.open_input_file(path) as f, media.zipfile.ZipFile(media._In(f)) as z:
        info = z.infolist()[1]
        assert reader.member(fs, path, Failing(), info) == media.to_wav(random.Random(1).randbytes(576)) and tries == [info.header_offset]
    assert len(pickle.dumps(media._Reader({"table": "x"}))) < 300


def test_member_retry(tmp_path, spark):
    out = media._Out(str(tmp_path))
    for i in range(3):
        out.add(i, 5, media.to_wav(random.Random(i).randbytes(576)))
    uri, size, _ = out.close()
    reader = media._Reader({"archives": f"{uri}\t{size}", "retries": "2"})
    rows = [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
    assert [r["key"] for r in rows] == [0, 1, 2]
    data = bytearray(open(uri, "rb").read())  # noqa: SIM115
    data[rows[1]["offset"] + 100] ^= 255
    open(uri, "wb").write(data)  # noqa: SIM115
    with pytest.raises(OSError, match=f"at {rows[1]['offset']}"):
        list(reader.read(reader.partitions()[0]))


# pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_keeps_columns_that_clash(spark, tmp_path):
    names = ["times", "__times", "__uid", "uid", "rejected", "p_toxic", "fp", "size", "copies", "target", "bucket", "c0"]
    d = docs(spark, [" ".join(words(40 + i, 500 + i)) for i in range(12)] * 2).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, d, str(tmp_path))
        assert out.columns == d.columns and all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() == 24


def test_batch_sizes():
    assert [arrow.size_of(x) for x in ("64m", "67108864", "64MB", "1g", "-1", "512k")] == [64 << 20, 64 << 20, 64 << 20, 1 << 30, -1, 512 << 10]


def test_pipeline_stages(spark, nothing, tmp_path):
    p = words(60, 40)
    texts = [" ".join(words(40 + i, 500 + i)) for i in range(30)]
    texts += [texts[3], None, "", " ".join(words(30, 41) + p), " ".join(p + words(30, 42))]
    d = docs(spark, texts)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, d, str(tmp_path)).count() == len(texts)  # nothing is labelled
    near = stages["simhash"](spark, d, str(tmp_path)).collect()
    assert len(near) == len(texts) - 2 and {r.doc_id for r in near} == set(range(35)) - {30, 32}
    cut = {r.doc_id: r.text for r in stages["substrings"](spark, spark.createDataFrame(near, DOCS), str(tmp_path)).collect()}
    assert cut[34].split() == words(30, 42) and cut[33] == texts[33]
    mixed = stages["mixing"](spark, d, str(tmp_path))
    assert mixed.columns == d.columns and mixed.count() > 0
    last = stages["bpe"](spark, d, str(tmp_path)).collect()
    assert all(r.exact for r in last) and len(last) == len(texts)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, nothing, str(tmp_path)).count() == 0, name




@pytest.mark.parametrize("stage", ["simhash", "mixing"])
def test_stages_number_rows_once(spark, tmp_path, monkeypatch, stage):
    """Files are packed into other tasks after the first stored table, as when executors come or go."""
    texts = [" ".join(words(40, 2000 + i % 30)) for i in range(40)]
    docs(spark, texts).repartition(8).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    f = dict(corpus_pipeline.STAGES)[stage]
    option, cost, store = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", corpus_pipeline.materialize

    def key(rows):
        return sorted((r.doc_id, r.text) for r in rows)

    def moved(df, tag):
        out = store(df, tag)
        spark.conf.set(option, "128m")
        spark.conf.set(cost, "0")
        return out

    try:
        for name, m in (("fixed", store), ("moved", moved)):
            spark.conf.set(option, "4k")
            spark.conf.set(cost, "4m")
            monkeypatch.setattr(corpus_pipeline, "materialize", m)
            rows = key(f(spark, d, str(tmp_path)).collect())
            if stage == "simhash":
                assert [r[0] for r in rows] == list(range(30)), name
            elif name == "fixed":
                want = rows
            else:
                assert rows == want
    finally:
        spark.conf.unset(option)
        spark.conf.unset(cost)
