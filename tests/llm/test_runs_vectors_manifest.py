"""Periodic runs, near vectors and the Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ledgerops.llm import merkle, near_vectors, periodic


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(w):
    out, seen = [], set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(6, 4 * q) and (s, size) not in seen:
                seen.add((s, size))
                out.append((s, size, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_op11(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept))


def test_runs_equal_brute_force_on_random_texts():
    rng = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 70), rng.randint(0, 4)
            w = [rng.randint(0, k) for _ in range(n)]
            if rng.random() < 0.6 and n > 4:
                a = rng.randint(0, n - 1)
                p = rng.randint(1, max(1, (n - a) // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        found = list(zip(*(x.tolist() for x in periodic.find_runs(np.array(sum(texts, []), dtype=np.int64), row))))
        want, at = [], 0
        for w in texts:
            want += [(s + at, size, q) for s, size, q in brute_runs(w)]
            at += len(w)
        assert found == want


def test_op11_equals_brute_force_and_takes_odd_rows(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "Ä", "dd"][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    texts += [None, "", " \t\n", "x", "a b a b a b a b a b a b", " ha\tha\nha ha  ha ha ", "la " * 30_000, " ".join(str(i % 9_000) for i in range(40_000))]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(7, texts[7], "again"), (None, "u v " * 9, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = periodic.digest(periodic.periodic_runs(periodic.repeat_tails(docs))).collect()
    small = [r for r in rows if len(r[1] or "") < 5000]
    key = lambda r: tuple((x is None, x) for x in r)
    long_ids = {r[0] for r in rows if len(r[1] or "") >= 5000}
    assert sorted((tuple(r) for r in found if r.doc_id not in long_ids), key=key) == sorted((brute_op11(i, t) for i, t, _ in small), key=key)
    by_id = {r.doc_id: r for r in found}
    la, turns = (next(i for i, r in enumerate(rows) if (r[1] or "").startswith(x)) for x in ("la la", "0 1 2"))
    assert (by_id[la].n_runs, by_id[la].length, by_id[la].period) == (1, 30_000, 1) and by_id[la].collapsed_sha256 == sha("la")
    if zlib.crc32(str(turns).encode()) % 10:
        assert (by_id[turns].length, by_id[turns].period, by_id[turns].exponent_milli) == (40_000, 9_000, 4_444)
    assert periodic.digest(periodic.periodic_runs(periodic.repeat_tails(docs.limit(0)))).collect() == []


def brute_links(rows, cosine=0.9):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=float)
            x = x / np.abs(x).max()
            good[i] = x / np.linalg.norm(x)
    near = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cosine} if i in good else set() for i in range(len(rows))}
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(near[i]), least, vec_id == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [40, 8192])
def test_near_vectors_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(near_vectors, "CELL", cell)
    monkeypatch.setattr(near_vectors, "_TILE", 64)
    rng = np.random.default_rng(2)
    def around(centre, n, size):
        return [centre + size * rng.standard_normal(len(centre)) for _ in range(n)]
    vectors = list(rng.standard_normal((150, 24)))
    for n, size in ((120, 0.05), (20, 0.3), (20, 0.45)):  # a tight group over several parts, and groups with links about the threshold
        vectors += around(rng.standard_normal(24), n, size)
    chain = np.linspace(0, 3, 40)
    vectors += [np.cos(t) * np.eye(24)[0] + np.sin(t) * np.eye(24)[1] for t in chain]
    rows = [[float(x) for x in np.float32(v)] for v in vectors]
    rows += [rows[3]] * 30 + [[2 * x for x in rows[5]], None, [], [0.0] * 24, [1.0] + [None] * 23, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [1e300] * 24, [1e-300] * 24, [1.0, 2.0], [2.0, 4.1], [3.0], [-3.0], [1.0]]
    rows = [(i, v) for i, v in enumerate(rows)]
    rows += [(4, rows[9][1]), (None, rows[10][1]), (None, None)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, node int")
    found = near_vectors.near_groups(df)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_links(rows)
    if cell == 40:
        single = spark.createDataFrame([(i, [float(np.float32(a)) if a is not None else None for a in v] if v is not None else None) for i, v in rows if not v or v[0] not in (1e300, 1e-300)], "vec_id long, embedding array<float>")
        assert sorted((tuple(r) for r in near_vectors.near_groups(single).collect()), key=str) == brute_links([tuple(r) for r in single.collect()])
        assert near_vectors.near_groups(df.limit(0)).collect() == []


def brute_manifest(rows):
    def h(text):
        return hashlib.sha256(text.encode()).hexdigest()
    def leaf(row, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))
    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels
    def path(levels, pos):
        for nodes in levels[:-1]:
            first = pos - pos % 3
            yield nodes[first:pos], nodes[pos + 1 : first + 3]
            pos //= 3
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r, r[1]) for r in sorted(groups[s], key=lambda r: (r[0] is not None, r[0], leaf(r, r[1])))]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for pos, row in enumerate(sorted(groups[s], key=lambda r: (r[0] is not None, r[0], leaf(r, r[1])))):
            steps = [*path(trees[s], pos), *path(top, k)]
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            acc = leaf(row, row[1].replace("\n", "") if even and row[1] is not None else row[1])
            for left, right in steps:
                acc = h("".join([*left, acc, *right]))
            proof = h("".join(d for left, right in steps for d in left + right))
            out.append((row[0], leaf(row, row[1]), trees[s][-1][0], top[-1][0], proof, acc, acc == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, f"line {i}\nof {rng.random()}" * rng.randint(1, 3), rng.choice(["en", "de", None]), rng.choice(["web", "web", "web", "code", "", None, "Ä", "é", "\U0001f600", "￮"]), i % 7) for i in range(400)]
    rows += [(1000, None, None, "alone", None), (None, "x\ny", "en", "web", 3), (5, "again\n", "en", "web", 2), (5, "again\n", "en", "web", 2), (1001, "", "", "alone too", 0), (1002, "w\n" * 20_000, "en", "web", 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "e", "e") for r in rows], "doc_id long, text string, lang string, source string, n_chars int, leaf string, tree string")
    want = brute_manifest(rows)
    assert sorted((tuple(r) for r in merkle.verified(docs).collect()), key=str) == want
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    assert sorted((tuple(r) for r in merkle.verified(docs).collect()), key=str) == want
    assert merkle.verified(docs.limit(0)).collect() == []
    one = docs.where("doc_id = 1000")
    (only,) = merkle.verified(one).collect()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.verified and only.proof_sha256 == sha("")
