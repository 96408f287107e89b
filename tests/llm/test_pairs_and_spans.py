"""Similarity join, decontamination, fingerprints, mixing: against brute force on small tables with every odd case."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerops.llm import decontaminate, fingerprints, mixing, ngram_join
from ledgerops.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, source string, id int, k1 string, text_hash string, bucket int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def texts():
    """Copies, edited copies, repeated ids, short, empty, null and long texts."""
    r = random.Random(3)
    make = lambda n: [f"w{r.randrange(400)}" for _ in range(n)]
    out = [None, "", " \t\n", "One", "one", "a b c", "A  b\nC", "ünï Ünï x y z q", "x " * 30]
    for _ in range(12):
        base = make(r.choice([6, 20, 60, 200]))
        for _ in range(r.randrange(1, 7)):
            copy = list(base)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(50)}"
            out.append(" ".join(copy))
    group = make(120)
    for i in range(60):
        out.append(" ".join(group[: 100 + i % 20]))
    out.append(" ".join(make(30_000)))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(out)]
    return rows + [rows[12], (rows[13][0], "another text under the same number"), (None, rows[14][1])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 4}" if (i or 0) % 9 else None, 0, "k", "h", 1) for i, t in texts], COLUMNS).repartition(3, "doc_id")


def test_join_is_exact(docs, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "_BLOCK", 16)  # so that groups are cut into several blocks
    named = [(i, t) for i, t in texts if i is not None]
    sets = [shingles(t) for _, t in named]
    links = [0] * len(named)
    root = {i: i for i, _ in named}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(named)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(named[a][0]), find(named[b][0])
                root[max(x, y)] = min(x, y)
    got = ngram_join.jaccard_groups(docs).collect()
    assert len(got) == len(texts)
    want = sorted((i, len(s), n) for (i, _), s, n in zip(named, sets, links))
    assert sorted((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got if r["doc_id"] is not None) == want
    by_id = {}
    for r in got:
        if r["doc_id"] is not None:
            by_id[r["doc_id"]] = min(r["component_id"], by_id.get(r["doc_id"], 1 << 60))
    alone = {i for i, _ in named} - {i for i, n in zip([x[0] for x in named], links) if n}
    assert all(by_id[i] == find(i) for i in by_id if i in alone or [x[0] for x in named].count(i) == 1)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_join_of_one_id_in_many_batches(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_BATCH", 8)
    rows = [(7, f"a{i} b{i} c{i} d{i} e{i} f{i}" if i % 8 else f"w{i}") for i in range(24)] + [(9, "a13 b13 c13 d13 e13 f13"), (9, "w16"), (9, "w16 x"), (9, "a2 b2 c2 d2 e2 f2")]
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    sets = [shingles(t) for _, t in rows]
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = []
    for k, ((i, _), a) in enumerate(zip(rows, sets)):
        met = [rows[j][0] for j, b in enumerate(sets) if j != k and linked(a, b)]
        want.append((i, len(a), min([i, *met]), len(met)))
    assert sorted(tuple(r) for r in got) == sorted(want) and sum(w[3] for w in want) == 6


def test_one_of_each_group_stays(docs):
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_groups(docs).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert set(ids) == {i for i in groups if i is None or groups[i] == i}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100), (200, None), (61, 60)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(51)}, 60: 60, 61: 60}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.jaccard_groups(none).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, items).collect())
    assert fingerprints.compare_edited(none).count() == 0
    assert mixing.taken(none).count() == 0
    assert mixing.mixed(none).count() == 0


def _plain_contamination(text, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) if w]
    w, hit, met = split(text), set(), set()
    for item_id, item in items:
        i = split(item)
        span = min(10, len(i))
        grams = {tuple(i[p : p + span]) for p in range(len(i) - span + 1)} if i else set()
        for p in range(len(w) - span + 1):
            if tuple(w[p : p + span]) in grams:
                hit.update(range(p, p + span))
                if item_id is not None:
                    met.add(str(item_id))
    return len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


def test_contamination_is_exact(spark, docs, texts):
    r = random.Random(8)
    source = [t for _, t in texts if t and len(words(t)) > 20]
    items = [(1, None), (2, ""), (3, "One"), (4, "a b c"), (5, "a b c"), (None, "x y z q"), (6, "x x x x x x x x x x x x")]
    for k in range(30):
        w = words(r.choice(source))
        at, n = r.randrange(len(w)), r.choice([9, 10, 11, 30])
        items.append((10 + k, "new words before " + "; ".join(w[at : at + n]).upper() + " and after"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(x) for x in decontaminate.contamination(docs, bench).na.fill({"doc_id": -1}).collect())
    want = sorted((-1 if i is None else i, *_plain_contamination(t, items)) for i, t in texts)
    assert got == want
    assert any(x[2] for x in want)
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not x[-1] for x in want)


def test_fingerprints_of_edited_texts(docs, texts, monkeypatch):
    monkeypatch.setattr(fingerprints, "_BUCKET", 2000)
    rows = sorted(((i, t or "") for i, t in texts), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    got = fingerprints.compare_edited(docs).collect()
    want, likeness = [], {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        want.append((-1 if i is None else i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
        a, b = shingles(t), shingles(edited)
        likeness.setdefault((-1 if i is None else i, len(t)), len(a & b) / len(a | b) if a | b else 1.0)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    errors = [abs(r["near_edited"] - likeness[-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"]]) for r in got]
    assert sum(errors) / len(errors) < 0.05
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    plan = fingerprints.compare_edited(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_meets_targets(docs, texts):
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(texts)
    assert sum(r["size"] for r in rows) == sum(len(words(t)) for _, t in texts)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0 for r in rows)
    per = {r["source"]: r for r in rows}
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["target"] for r in per.values()) - total) < 1e-6 * total
    for s, r in per.items():
        own = [x for x in rows if x["source"] == s]
        assert r["target"] <= 3 * r["source_size"] + 1e-6
        assert abs(sum(x["taken"] for x in own) - r["target"]) <= max(x["size"] for x in own)
    again = mixing.taken(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sum(len(words(x["text"])) for x in out.collect()) == sum(r["taken"] for r in rows)


def test_mix_of_some_of_equal_rows(spark):
    # targets 22.5, 9 and 4.5 words: one of the five equal rows of c is taken
    rows = [(1, "a b c d e f g h i j", "a"), (2, "k l m n s t", "b")] + [(3, "o p q r", "c")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["source"]: r["t"] for r in mixing.taken(docs).groupBy("source").agg(mixing.F.sum("taken").alias("t")).collect()}
    got = {s: sum(len(words(r["text"])) for r in mixing.mixed(docs).where(f"source = '{s}'").collect()) for s in "abc"}
    assert got == taken and taken["c"] == 4


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 500), ("c", 90), (None, 0), ("d", 400)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights a 5, b 2, c 1, d 5, null 2: a is capped at 30, null at 0, the rest share 970 by 2 : 1 : 5
    assert got[None] == 0 and got["a"] == 30
    assert [round(got[k], 6) for k in "bcd"] == [242.5, 121.25, 606.25]


def test_split_is_exact_and_disjoint(spark):
    quotas = spark.createDataFrame([("a", 101), ("b", 7), (None, 20), ("z", 0)], "source string, blocks long")
    rows = mixing.split(quotas, 8).collect()
    for source, n in (("a", 101), ("b", 7), (None, 20)):
        own = sorted((r["lo"], r["hi"]) for r in rows if r["source"] == source)
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    per_shard = [sum(r["hi"] - r["lo"] for r in rows if r["shard"] == s) for s in range(8)]
    assert sum(per_shard) == 128 and max(per_shard) - min(per_shard) <= 1


def test_shards_follow_the_words(spark):
    assert [mixing.shards_for(n) for n in (0, 1, mixing.SHARDS * mixing.SHARD_WORDS, mixing.SHARDS * mixing.SHARD_WORDS + 1, 5 * 10**9)] == [16, 16, 16, 32, 512]
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"))
    few, many = mixing.mixed(docs, shards=4), mixing.mixed(docs, shards=64)
    assert few.rdd.getNumPartitions() == 4 and many.rdd.getNumPartitions() == 64
    assert sorted(r[0] for r in few.select("doc_id").collect()) == sorted(r[0] for r in many.select("doc_id").collect())


def test_shared_sentence_grows_in_proportion(spark, monkeypatch):
    sentence = " ".join(f"s{i}" for i in range(20))
    items = [(i, f"q{i} {sentence} r{i}") for i in range(30)]
    rows = [(i, f"a{i} b{i} {sentence} c{i}") for i in range(40)] + [(40, "nothing of the kind"), (0, f"a0 b0 {sentence} c0"), (41, None)]
    sizes, plain = {}, decontaminate.written

    def counted(df, label):
        out = plain(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(decontaminate, "written", counted)
    docs, bench = (spark.createDataFrame(x, f"{k} long, text string") for x, k in ((rows, "doc_id"), (items, "item_id")))
    got = sorted(tuple(x) for x in decontaminate.contamination(docs, bench).collect())
    assert got == sorted((i, *_plain_contamination(t, items)) for i, t in rows)
    # a row per place where a shared window begins, not per document and item
    assert sizes["shared"] <= 41 * 11 and sizes["hits"] == 40
