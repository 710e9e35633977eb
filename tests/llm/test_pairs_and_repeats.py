"""Spelling variants, hard negatives and repeated word sequences against brute-force versions, and their edges."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftledger.llm import negatives, spelling, substrings

DOCS = "doc_id long, text string, word string, n int, id string, chunk int, `key` long, begins string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "x", 0, 3, "b") for i, t in rows], DOCS)


# spelling


def near_by_hand(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(rows, slip=None, least=6, occurs=5, ratio=5):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    words = {w: n for w, n in total.items() if len(w) >= least and n >= occurs}
    near = {w: [x for x in words if near_by_hand(w, x)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def spelled(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_bit_slices_find_every_single_error():
    r = random.Random(4)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(400)} | {"a" * 300, "a" * 299, "b" + "a" * 299})
    queries = words[::2] + ["zzz", "abz", "aé"]
    q, w = spelling.BitSlices(words).near(queries)
    got = sorted(zip(q.tolist(), w.tolist()))
    assert got == [(i, j) for i, a in enumerate(queries) for j, b in enumerate(words) if near_by_hand(a, b)]
    assert spelling.BitSlices([]).near(["abc"])[0].size == 0 and spelling.BitSlices(["abc"]).near([])[0].size == 0


@pytest.mark.parametrize(("shard", "piece"), [(4096, 8192), (40, 8), (1, 3)])
def test_variants(spark, shard, piece):
    r = random.Random(9)
    base = ["".join(r.choice("abcdeéÿ") for _ in range(r.randint(6, 9))) for _ in range(12)] + ["aaaaaaa", "aaaaaa", "ababab"]
    pool = []
    for w in base:
        pool += [w] * 400
        for _ in range(12):
            k = r.randrange(len(w))
            pool += [r.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "z" + w[k + 1 :]])] * r.choice([1, 5, 20, 90])
    r.shuffle(pool)
    rows = [(i, " ".join(pool[i::60])) for i in range(60)] + [(None, base[0].upper() + "." + base[1]), (None, None), (3, ""), (7, "É" * 7)]
    rows += [(99, "long" * 1000), (99, "long" * 1000)] * 3
    out = spelled(spelling.variants(docs_of(spark, rows), slip=19, shard=shard, piece=piece))
    assert out == variants_by_hand(rows, 19) and any(v[2] for v in out.values())


def test_variants_follow_forms_to_the_root(spark):
    chain = [("abcdefgh", 5), ("abcdefg", 25), ("abcdef", 125), ("abcdefx", 3000), ("zzzzzzz", 4)]
    rows = [(i, w) for w, n in chain for i in range(n)]
    out = spelled(spelling.variants(docs_of(spark, rows)))
    assert out == variants_by_hand(rows) and out["abcdefgh"][4] == "abcdefx"
    assert spelling.variants(docs_of(spark, rows).limit(0)).count() == 0
    assert spelling.variants(docs_of(spark, [(1, None), (2, "a b")])).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs_of(spark, rows), least=5)


# hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, id string, score string, `key` int, anchor_id int"


def mined_by_hand(rows, every, positives=5, take=3):
    good = [
        (i, lab, np.floor(256 * np.array(v, float)))
        for i, v, lab in rows
        if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    asks = {}
    for i, lab, v in good:
        if i % every == 0:
            asks[i] = min(asks.get(i, (lab, v.tolist())), (lab, v.tolist()))
    out = []
    for a, (lab, v) in asks.items():
        scored = sorted((-int(w @ np.array(v)), i, own == lab) for i, own, w in good if i != a and len(w) == len(v))
        for s, i, _ in [x for x in scored if x[2]][:positives]:
            fits = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:take]
            out += [(a, i, k, j, -s, -t) for k, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], VECTORS)


@pytest.mark.parametrize("block", [negatives.BLOCK, 700])
def test_hard_negatives(spark, block):
    r = np.random.default_rng(6)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(x) / 256 for x in r.integers(-3, 9, 5)], int(r.integers(0, 3))) for i in range(240)]
    rows += [(i, [0.25, 0.5, 0.25, 0.5, 1.0], i % 2) for i in range(300, 340)]  # ties
    rows += [(400, [1.0, 2.0], 0), (401, [1.0, 1.5], 0), (402, [1.0, 1.0], 1), (403, [1.0, 1.0], 1), (405, [], 0), (406, [], 0), (407, [], 1)]
    rows += [(410, None, 1), (411, [1.0] * 5, None), (None, [1.0] * 5, 1), (412, [nan] * 5, 1), (413, [inf] + [1.0] * 4, 0), (414, [None] * 5, 0)]
    rows += [rows[10], rows[11], (10, [1.0] * 5, 2)]  # repeated rows, and an id with two labels
    df = vectors_of(spark, rows).repartition(7)
    got = sorted(tuple(x) for x in negatives.mine(df, "vec_id % 5 = 0", block=block).collect())
    assert got == mined_by_hand(rows, 5) and got
    assert negatives.mine(df.limit(0), "vec_id % 5 = 0").count() == 0
    assert negatives.mine(df, "vec_id = 410").count() == 0


# repeated word sequences


def removed_by_hand(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    name = [(i is None, i or 0) for i, _ in rows]
    for k, w in enumerate(words):
        for s in range(len(w) - length + 1):
            t = tuple(w[s : s + length])
            first[t] = min(first.get(t, ((True, 1 << 63), 0)), (name[k], s))
    out = []
    for k, w in enumerate(words):
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] != (name[k], s):
                gone.update(range(s, s + length))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((rows[k][0], len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "base", "slot"), [(20, 10, 1 << 24), (20, 5, 90_000), (7, 2, 50_000)])
def test_repeated_word_sequences(spark, length, base, slot):
    r = random.Random(length)
    words = ["a", "bb", "é", "X", "x", "\0", "中文"] + [f"w{i}" for i in range(25)]
    passages = [" ".join(r.choice(words) for _ in range(n)) for n in (length - 1, length, length + 1, 50, 200)]
    rows = [(i, "  ".join(r.choice([*passages, *words]) for _ in range(r.randint(1, 30)))) for i in range(60)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1] + " end"), (None, rows[4][1]), (None, rows[5][1] + "\t" + passages[3])]
    rows += [(7, rows[7][1]), (7, passages[4]), (2000, "spam " * 3000), (1500, "spam " * 40), (1501, "a b " * 5000)]
    rows += [(3000, None), (3001, ""), (3002, " \n "), (3003, "a b c")]
    r.shuffle(rows)
    df = docs_of(spark, rows).repartition(5)
    out = substrings.remove_repeats(df, length, base=base, slot_bytes=slot).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256, x.kept) for x in out), key=repr) == removed_by_hand(rows, length)


def test_repeated_passages_around_the_length(spark):
    r = random.Random(2)

    def prose(n):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))

    rows, want = [], defaultdict(int)
    for k, n in enumerate((19, 20, 21, 60)):
        shared = prose(n)
        for copy in range(3):
            rows.append((10 * k + copy, f"{prose(30)} {shared} {prose(30)}"))
            want[10 * k + copy] = n if copy and n >= 20 else 0
    got = {x.doc_id: x.n_removed for x in substrings.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == dict(want)
    assert substrings.remove_repeats(docs_of(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs_of(spark, rows), 10, base=10)
    assert substrings.lengths_of(20, 10) == [10, 20] and substrings.lengths_of(20, 3) == [3, 6, 12, 20]
