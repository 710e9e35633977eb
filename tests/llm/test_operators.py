"""The training-data operators against brute-force versions, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from driftledger.llm import balltree, curriculum, decontam, language, packing, queries, quality, simhash, suffixes
from driftledger.llm import toxicity, urls
from driftledger.llm.sql import ORACLES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, `key` long"


def docs_of(spark, texts, source="s"):
    rows = [(i, t, "en", source, 0, 0.5, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", "   ", "a", "A b", "a b c d e", "a b c d e", "é ñ 中文", "x" * 5000, "w " * 20000]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_rules_and_url_parts(spark):
    given = ["http://A.Example.NET/en/1?x=1#y", "https://net", "http://xnet/", "ftp://a.org/fr/q", "no scheme", None,
             "http://b.example.com/de/x", "http://c.example.com/en"]
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumnRenamed("page_id", "verdict")
    out = {r.url: r for r in urls.judge(df, queries.URL_RULES).collect()}
    assert len(out) == len(given)
    assert (out[given[0]].host, out[given[0]].path, out[given[0]].rule) == ("a.example.net", "/en/1", "example.net/en/")
    assert out[given[1]].rule is None and out[given[1]].path == ""
    assert out[given[2]].rule is None
    assert (out[given[3]].rule, out[given[3]].verdict) == ("org/fr/", "allow")
    assert (out[None].host, out[None].path) == ("", "") == (out["no scheme"].host, out["no scheme"].path)
    assert out[given[6]].verdict == "block"
    empty = urls.judge(df.limit(0), queries.URL_RULES)
    assert empty.count() == 0


def test_trees_learn_a_lexical_rule(spark):
    rows = [(i, f"http://h{i % 7}.example.net/{'en' if i % 3 else 'xx'}/{'9' * (i % 40)}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = urls.judge(df, queries.URL_RULES).collect()
    assert all(r.verdict == ("allow" if r.rule == "example.net/en/" else "block") for r in out)
    wrong = sum((r.block_score >= 0.5) != (r.verdict == "block") for r in out)
    assert wrong <= 0.4 * len(out)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = dict(docs.select("doc_id", "lang").collect())
    rows = queries.op2_language_id(spark, SF).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    docs = docs_of(spark, EDGES)
    model = language.train(docs.where("doc_id in (3, 4, 5)"))
    out = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [out[i].lang_pred for i in range(3)] == ["und"] * 3 and out[7].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language.identify(docs, language.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert language.identify(docs.limit(0), model).count() == 0


def index_by_hand(texts, labels, corpus):
    """Plain TF-IDF vectors of the examples, by dictionaries."""
    df = Counter(t for c in corpus for t in set(toxicity.terms(c)))
    space = {t for x in texts for t in toxicity.terms(x)}

    def vector(text):
        c = Counter(t for t in toxicity.terms(text) if t in space)
        v = {t: (1 + np.log(n)) * (np.log((1 + len(corpus)) / (1 + df[t])) + 1) for t, n in c.items()}
        length = sum(x * x for x in v.values()) ** 0.5
        return {t: x / length for t, x in v.items()}

    return vector, [vector(x) for x in texts]


def test_nearest_is_exact_and_blocks_are_skipped():
    r = random.Random(3)
    topics = [[f"{chr(97 + k)}{chr(97 + i)}x" for i in range(26)] for k in range(12)]
    texts = [" ".join(r.choice(topics[i % 12] + ["the", "of"]) for _ in range(r.randint(1, 40))) for i in range(900)]
    labels = [r.randint(0, 1) for _ in texts]
    names = [toxicity.hashed(t) for t in texts]
    vocabulary, term = np.unique(np.concatenate([n for n, _ in names]), return_inverse=True)
    frequency = np.bincount(np.concatenate([np.searchsorted(vocabulary, n) for n, _ in names]))
    index = toxicity.Index.of(
        vocabulary, frequency, len(texts), list(range(900)), labels, [len(n) for n, _ in names], term,
        np.concatenate([c for _, c in names]),
    )
    vector, known = index_by_hand(texts, labels, texts)
    asked = texts[:40] + ["the", "zzz", "", "abx zzz of of"]
    got = [list(zip(*x)) for x in index.nearest_of([index.vector(t) for t in asked], 15)]
    for text, found in zip(asked, got):
        own = vector(text)
        scores = ((-round(sum(x * v.get(t, 0) for t, x in own.items()), 9), i) for i, v in enumerate(known))
        want = sorted(x for x in scores if x[0])[:15]
        assert [s for s, _ in found] == pytest.approx([-s for s, _ in want], abs=1e-8)
        if not want:
            continue
        assert {int(index.ids[p]) for s, p in found if s > -want[-1][0] + 1e-8} == {i for s, i in want if s < want[-1][0] - 1e-8}
    assert index.skipped > index.read / 4


def test_toxicity(spark):
    clean = [f"good morning number {i} of the nice days" for i in range(300)]
    toxic = [f"you are a {'idiot' if i % 2 else 'moron'} said number {i}" for i in range(80)]
    docs = docs_of(spark, clean + toxic + EDGES)
    rows = [(i, int(i >= 300)) for i in range(380) if i % 5] + [(None, 1), (5, None), (1, 0), (9999, 1)]
    index = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    out = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    assert len(out) == len(clean + toxic + EDGES)
    assert all(out[i].predicted == int(i >= 300) for i in range(380)) and out[380].predicted == 0
    assert all(0 <= r.score <= 1 for r in out.values()) and out[301].evidence and not out[380].evidence
    none = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0


def test_toxicity_compares_whole_texts(spark):
    # no term tells the labels apart beyond chance, and yet every text has its nearest examples
    texts = ["red fox", "blue whale", "green frog", "red fox jumps", "whale", "unheard " * 3, "green " + "q" * 200]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert [out[i].evidence[0].id for i in (0, 1, 2, 3, 4, 6)] == [0, 1, 2, 0, 1, 2] and not out[5].evidence
    vector, known = index_by_hand(texts[:3], [0, 0, 1], texts)
    for i, t in enumerate(texts):
        want = sorted((round(s, 9) for v in known if (s := sum(x * v.get(w, 0) for w, x in vector(t).items()))), reverse=True)
        assert [e.cosine for e in out[i].evidence] == pytest.approx(want, abs=1e-8)


def test_toxicity_query_equals_plain_cosines(spark):
    """Every document's evidence on the whole smallest tables, against dictionaries."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect())
    taught = {i: y for i, y in labels.items() if y is not None and i in docs and zlib.crc32(str(i).encode()) % 5}
    index = toxicity.train(
        spark.read.parquet(f"{SF}/documents.parquet"),
        spark.createDataFrame(list(taught.items()), "doc_id long, toxic int"),
    )
    got = toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), index, k=10).collect()
    single = {}
    for i in index.ids.tolist():
        single[docs[i]] = i
    vector, known = index_by_hand(list(single), None, list(docs.values()))
    assert len(got) == len(docs) and set(single) == {docs[i] for i in taught if toxicity.terms(docs[i])}
    for r in got:
        own = vector(r.text)
        scores = [sum(x * v.get(t, 0) for t, x in own.items()) for v in known]
        assert [e.cosine for e in r.evidence] == pytest.approx(sorted((s for s in scores if s), reverse=True)[:10], abs=1e-8)


def test_toxicity_of_mostly_toxic_labels(spark):
    r = random.Random(4)
    prose = [" ".join(r.choice("abcdefgh") * 3 for _ in range(12)) + f" n{chr(97 + i % 26)}" for i in range(300)]
    texts = [t + (" idiot" if i % 5 < 3 else "") for i, t in enumerate(prose)] + EDGES
    rows = [(i, int(i % 5 < 3)) for i in range(200)]
    docs = docs_of(spark, texts)
    index = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    out = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    assert all(out[i].predicted == int(i % 5 < 3) for i in range(300))
    # null, empty and blank texts have no evidence
    assert all(out[i].predicted == 0 and not out[i].evidence for i in (300, 301, 302))


def test_toxicity_counts_terms_in_all_documents(spark):
    docs = docs_of(spark, ["red fox", "blue fox", *["red red"] * 7, None])
    index = toxicity.train(docs, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int"))

    def idf(word):
        return index.idf[np.searchsorted(index.vocabulary, toxicity.hashed(word)[0][0])]

    assert idf("red") == pytest.approx(np.log(11 / 9) + 1) and idf("blue") == pytest.approx(np.log(11 / 2) + 1)


def test_terms_of_scripts_without_spaces():
    assert toxicity.terms("Ein Wort, 中文字 ไทย é") == ["ein", "wort", "中文", "文字", "ไท", "ทย", "é"]
    assert toxicity.terms("字") == ["字"] and toxicity.terms(None) == [] == toxicity.terms("12 _ ")


def test_gumbel_top_is_exact(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)] + [(1, 1.0)] * 3, "doc_id long, log_weight double")
    for k in (0, 1, 100, 503, 900):
        rows = quality.gumbel_top(df, k).collect()
        keys = sorted((r.key for r in rows), reverse=True)
        assert sum(r.selected for r in rows) == min(k, 503)
        assert all(r.selected == (r.key >= keys[k - 1]) for r in rows) if 0 < k < 100 else True


def test_quality(spark):
    rows = queries.op3_quality_resampling(spark, SF).collect()
    assert len(rows) == 200 and sum(r.selected for r in rows) == 100
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int")
    assert quality.resample(docs_of(spark, EDGES), labels).count() == len(EDGES)
    assert quality.resample(docs_of(spark, EDGES).limit(0), labels).count() == 0


def test_quality_learns_from_all_good_documents(spark):
    docs = spark.range(104_000, numPartitions=4).selectExpr("id as doc_id", "concat('w', id % 97, ' v', id % 89) as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2 = 0) as quality")
    ratio = quality.log_ratio(quality.ngram_counts(docs.where("doc_id % 2 = 0")), quality.ngram_counts(docs))
    want = dict(quality.weights(docs.where("doc_id < 500"), ratio).select("doc_id", "log_weight").collect())
    got = quality.resample(docs, labels).where("doc_id < 500").select("doc_id", "log_weight").collect()
    assert all(abs(want[i] - w) < 1e-9 for i, w in got) and len(got) == 500


def test_quality_moves_few_texts(spark):
    docs = spark.range(20_000, numPartitions=4).selectExpr("nullif(id, 5) as doc_id", "concat('w', id % 97) as text")
    docs = docs.unionByName(docs.where("doc_id % 1000 = 1"))
    good = docs.where("doc_id % 3 = 0").select("doc_id").distinct().unionByName(spark.createDataFrame([(-4,)], "doc_id long"))
    want = Counter((r.doc_id, r.text) for r in docs.join(good, "doc_id", "left_semi").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bound in (1, 1 << 12, quality.CELLS):
            told, joined = quality.good_texts(docs, good, 20_020, bound=bound)
            moved = joined.count()
            assert Counter((r.doc_id, r.text) for r in told.unionByName(joined).collect()) == want
        assert moved < 0.1 * want.total()
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (told, joined)]
        assert "Exchange hashpartitioning" not in plans[0]
        assert plans[1].index("SortMergeJoin") < plans[1].index("BroadcastHashJoin")  # the texts that move have been sifted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def removed_by_hand(texts, length):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(spark, hot):
    r = random.Random(5)
    word = ["".join(r.choice("abcdé") for _ in range(5)) for _ in range(40)]
    passage = [" ".join(r.choice(word) for _ in range(30)) for _ in range(4)]
    texts = [" ".join(r.choice([*passage, *word]) for _ in range(r.randint(1, 12))) for _ in range(30)]
    texts += [texts[0], texts[0], "ab" * 300, "x" * 2000, None, "", texts[3][:-5] + "zz"]
    out = {r.doc_id: r for r in suffixes.remove_repeats(docs_of(spark, texts), 40, kgram=12, hot=hot).collect()}
    got = [(out[i].n_bytes, out[i].n_removed, out[i].n_spans, out[i].kept_sha256) for i in range(len(texts))]
    assert got == removed_by_hand(texts, 40)


def test_repeats_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    out = {r.doc_id: r for r in queries.op5_suffix_dedup(spark, SF).collect()}
    want = removed_by_hand([d.text for d in docs], 400)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (out[d.doc_id] for d in docs)] == want
    assert suffixes.remove_repeats(docs_of(spark, [None]).limit(0)).count() == 0


def test_planted_passages(spark):
    r = random.Random(4)

    def prose(n):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))

    # cut to size, between signs that differ; 52 words are 363 bytes
    texts, want = [prose(300) for _ in range(20)], [(0, 0)] * 20
    for size in (363, 399, 400, 401, 700):
        shared, inner = prose(120)[:size], prose(120)[:size]
        texts += [f"{prose(40)}{sign}{shared}{sign}{prose(40)}" for sign in "012"]
        texts.append(f"{prose(40)}3{inner}4{prose(40)}5{inner}6")
        want += [(size, 1)] * 3 + [(2 * size, 2)] if size >= 400 else [(0, 0)] * 4
    out = {r.doc_id: r for r in suffixes.remove_repeats(docs_of(spark, texts)).collect()}
    assert [(out[i].n_removed, out[i].n_spans) for i in range(len(texts))] == want
    assert [out[i].n_bytes for i in range(len(texts))] == [len(t) for t in texts]


def test_contexts_of_a_common_passage_are_split(spark):
    every = spark.range(120_000, numPartitions=12).selectExpr(
        "if(id % 3 = 0, 7, id % 90000) as h", "if(id % 1000 = 1, 2L, 1L) as m", "id as s"
    )
    count = Counter()
    rows = every.collect()
    for x in rows:
        count[x.h] += x.m
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "12",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    kept = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = suffixes.recurring(every).select("h", "m", "s", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(x[:3] for x in got) == sorted(x[:] for x in rows if count[x.h] >= 2)
    tasks = defaultdict(set)
    for x in got:
        tasks[x.h].add(x.task)
    assert len(tasks[7]) >= 4


def test_mix_edges(spark):
    rows = [(1, "a", 10), (1, "a", 10), (2, "a", None), (3, None, 7), (4, "b", 100), (None, "b", 3), (5, "c", 0)]
    out = curriculum.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * (r.size or 0) for r in out)
    per = defaultdict(int)
    for r in out:
        per[r.source] += r.taken
        assert len(r.positions) == -(-r.taken // r.size) if r.taken else not r.positions
    target = {r.source: r.target for r in out}
    assert abs(sum(target.values()) - 130) < 1e-9
    assert all(0 <= target[s] - n < 1 for s, n in per.items())
    stream = curriculum.training_stream(curriculum.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")))
    places = [r.position for r in stream.collect()]
    assert places == sorted(places)


def simhash_by_hand(texts):
    prints = []
    for t in texts:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(p, find(i)) for i, p in enumerate(prints)]


def test_simhash(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()] + EDGES
    out = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert [(out[i].fp % (1 << 64), out[i].component_id) for i in range(len(texts))] == simhash_by_hand(texts)
    assert simhash.near_duplicates(docs_of(spark, EDGES).limit(0)).count() == 0


def test_near_pairs_lose_none(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 4))}) for b in base for _ in range(12)} | {0, (1 << 64) - 1}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = sorted((x.a, x.b) for x in simhash.near_pairs(df).collect())
    want = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    assert got == sorted(want)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200) if i != 99]
    out = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(root == (0 if node <= 99 else 100) for node, root in out.items()) and len(out) == 201


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [-1.0, -2.0]), (8, [1.0, 2.0, 3.0]), (50, [0.5, 0.5]), (None, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = [tuple(r) for r in balltree.top_k(df, "vec_id % 50 = 0", 3).orderBy("query_id", "rank").collect()]
    five = 256 * 256 * 5
    assert out == [(0, 1, 1, five), (0, 2, 2, five), (0, 3, 50, 98304), (50, 1, 0, 98304), (50, 2, 1, 98304), (50, 3, 2, 98304)]
    assert balltree.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_top_k_in_small_cells(spark):
    r = np.random.default_rng(2)
    v = r.integers(-200, 200, (300, 8))
    rows = [(i, [float(x) / 256 for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = defaultdict(list)
    for q in balltree.top_k(df, "vec_id % 5 = 0", 4, centres=6, shard=20, block=16).orderBy("query_id", "rank").collect():
        out[q.query_id].append((q.vec_id, q.score))
    for i in range(0, 300, 5):
        scores = v @ v[i]
        assert out[i] == sorted(((j, int(s)) for j, s in enumerate(scores) if j != i), key=lambda x: (-x[1], x[0]))[:4]


def test_groups_stay_whole_while_bytes_stay_even():
    r = np.random.default_rng(3)
    bytes_ = np.concatenate([r.integers(50, 60, 4000), np.full(8 * 20, 100), np.full(400, 90)]).astype(float)
    demand = np.column_stack([bytes_, bytes_ / 5, np.ones(len(bytes_))])
    groups = np.concatenate([np.arange(4000), 4000 + np.repeat(np.arange(8), 20), np.full(400, 5000)])
    chosen = packing.place_groups(demand, groups, 8)
    filled = np.bincount(chosen, bytes_, 8)
    assert abs(filled / filled.mean() - 1).max() <= 0.002
    assert all(len(set(chosen[groups == 4000 + g])) == 1 for g in range(8))
    assert len(set(chosen[groups == 5000])) > 1  # above the largest share of a shard
    # nothing but large groups: balance goes first
    demand = np.column_stack([np.full(500, 100.0)] * 3)
    filled = np.bincount(packing.place_groups(demand, np.repeat(np.arange(5), 100), 4), minlength=4)
    assert list(filled) == [125] * 4
    assert len(packing.place_groups(demand[:0], np.zeros(0, np.int64), 4)) == 0


def test_packing(spark):
    texts = [f"text {i} " * (i % 30) for i in range(1500)] + ["copy " * 20] * 800 + EDGES
    rows = packing.shard(queries.shard_input(docs_of(spark, texts)), 8, bundles=64).collect()
    assert len(rows) == len(texts)
    slots, sizes, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        homes[r.g1, r.g2].add(r.shard)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 8 + 40000 / 8
    assert sum(len(h) > 1 for h in homes.values()) <= 2  # only the hot groups are cut
    assert packing.shard(queries.shard_input(docs_of(spark, []).limit(0)), 8).count() == 0


def test_packing_rows_without_id(spark):
    # a third of the rows are copies without an id, and one id repeats as often
    rows = [(None, "same text " * 3)] * 4000 + [(7, "again " * 4)] * 4000 + [(i, f"t {i}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    taken = ("item", "row", "id", "pieces", "doc", "n", "_item")
    docs = queries.shard_input(docs).select("*", *[F.lit(c).alias(c) for c in taken], F.lit(-1).alias("shard"))
    out = packing.shard(docs, 40).collect()
    sizes, counts, slots = Counter(), Counter(), defaultdict(list)
    for r in out:
        assert all(r[c] == c for c in taken)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        counts[r.doc_id, r.text_crc32] += 1
    assert counts == Counter((i, zlib.crc32(t.encode())) for i, t in rows)
    assert len(sizes) == 40 and max(sizes.values()) / (sum(sizes.values()) / 40) < 1.02
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing_whole_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    out = packing.shard(queries.shard_input(docs), 40).toPandas()
    assert len(out) == docs.count()
    filled = out.groupby("shard")["size"].sum()
    capacity, rows = filled.sum() / 40, len(out) / 40
    assert len(filled) == 40 and filled.max() / capacity < 1.02
    for _, copies in out.groupby(["g1", "g2"]):
        if copies["size"].sum() <= capacity / 4 and len(copies) <= rows / 4 and copies["tokens"].sum() <= out["tokens"].sum() / 160:
            assert copies["shard"].nunique() == 1
    # brute force of the greedy rule over groups as they are
    units = np.array([[g["size"].sum(), g["tokens"].sum(), len(g)] for _, g in out.groupby(["g1", "g2"])], float)
    left, want = np.ones((40, 3)), []
    share = units / (units.sum(axis=0) / 40)
    order = sorted(range(len(units)), key=lambda i: (-(512 * share[i, 0] + share[i, 1] + share[i, 2]), i))
    for i in order:
        scores = [512 * left[s, 0] * share[i, 0] + left[s, 1] * share[i, 1] + left[s, 2] * share[i, 2] for s in range(40)]
        want.append(max(range(40), key=lambda s: (scores[s], -s)))
        left[want[-1]] -= share[i]
    assert list(packing.place(units, 40)[order]) == want


def test_decontamination_in_blocks(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 3, 12, 13, 14, 30, 40)] + [None, "!!", "A B-c"]
    texts = [" ".join([r.choice(words) for _ in range(20)] + [r.choice(items[:7])[: r.randint(5, 300)]]).upper() for _ in range(60)]
    texts += EDGES + ["x. a\nb,C y", items[5], items[5]]
    bench = spark.createDataFrame([*enumerate(items), (99, items[5]), (None, items[4])], "item_id long, text string")
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def want(text):
        w = split.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        hit, met = set(), set()
        for i, t in [*enumerate(items), (99, items[5])]:
            item = split.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
            n = min(13, len(item))
            known = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in known:
                    hit.update(range(k, k + n))
                    met.add(str(i))
        return len(w), len(hit), sorted(met), bool(hit) and 20 * len(hit) >= len(w)

    for block in (decontam.BLOCK, 300):
        out = {x.doc_id: x for x in decontam.contamination(docs_of(spark, texts), bench, block=block).collect()}
        assert [(x.n_words, x.n_hit, x.item_ids, x.contaminated) for x in (out[i] for i in range(len(texts)))] == [want(t) for t in texts]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    assert len(toxic) >= 0.8 * docs.count()
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs.union(docs.limit(20)), SF).collect())
    assert kept == sorted({root for _, root in simhash_by_hand(texts)})
    clean = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()}
    assert clean == {r.doc_id for r in queries.op10_winnowing(spark, SF).where("not contaminated").collect()}
    mixed = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    taken = queries.op6_curriculum_mix(spark, SF).where("taken > 0").collect()
    assert mixed == Counter({r.doc_id: -(-r.taken // r.size) for r in taken})
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r.shard for r in out} <= set(range(40))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
