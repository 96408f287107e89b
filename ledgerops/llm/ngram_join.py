"""Self-join of documents on the Jaccard similarity of their word shingles, exact, by signature trees.

1. One pass over the texts makes each document's set of shingle hashes. It keeps the set's size and key, and deals a fixed
   part of the hash space (``_SAMPLE``) out by hash: a document of which too few of these hashes occur anywhere else
   cannot have a partner, and leaves. What is left are candidates, one for each distinct set.
2. Their sets are made again and counted exactly: a hash found in one set only can be in no intersection. With s shared
   hashes and at least ``need`` common ones in any link, the first s - need + 1 shared hashes in an order common to all
   (rare first) hold one of each partner's. Every hash leads to the least document that has it, and documents meet under
   these leaders; a leader with many documents is cut into blocks, and pairs of blocks go to different tasks.
3. In each block or pair of blocks, a signature tree: leaves are documents, with one bit for each hash that occurs twice
   here; nodes OR the bits of what is below and keep the range of sizes. Two trees are walked together, and a pair of nodes
   is dropped when its sizes are too far apart, when the bits in common are fewer than the least overlap of any link, or when
   all its documents already meet under an earlier leader. At the leaves the common bits are the intersection itself.
4. Each task gives one row per linked document (links, and a root in the task), never the pairs; star rounds make the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerops.llm import words as W
from ledgerops.llm.components import components
from ledgerops.llm.tables import fresh, give_back, slices, small, written

WIDTH, PERCENT = 5, 75
#: Part of the hash space that the first filter looks at, in 64ths; more than 1 - PERCENT is needed, any such value is exact.
_SAMPLE = 24
#: Documents in one batch of the first pass, and of a block of step 3.
_BATCH, _BLOCK = 4096, 512
#: Hashes that one task of a counting step takes, about.
_TOKENS = 1_000_000
_FAN = 8
_MANY = 0xFFFF


def least_overlap(size, percent: int):
    """Least intersection of a set of this size with any linked set: links need 100 i >= percent (a + b - i) and b >= i."""
    return -(-percent * size // 100)


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for piece in slices(iter([batch]), _BATCH, 1 << 19):  # word arrays are several times the text
        raw, bounds = W.text_bytes(piece.column(1))
        start, end, first = W.word_spans(raw, bounds)
        hashes = W.word_hashes(raw, start, end)
        out += [W.row_shingles(hashes[a:b], width) for a, b in zip(first[:-1], first[1:])]
    return out


def _key(hashes: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two numbers that, with the size, stand for a set."""
    return hashes.sum(dtype=np.uint64).astype(np.int64), W.mix(hashes ^ W._M1).sum(dtype=np.uint64).astype(np.int64)


def _batch_id(ids: np.ndarray, *keys: np.ndarray) -> int:
    """A number for a batch, from its rows' ids and the keys of their sets alone, so that a repeated task gives the same one."""
    rows = W.mix(ids.astype(np.uint64) + np.arange(len(ids), dtype=np.uint64) * W._BASE)
    for key in keys:
        rows = W.mix(rows ^ key.astype(np.uint64))
    return int(W.mix(rows.sum(dtype=np.uint64, keepdims=True))[0].astype(np.int64))


def _by_bucket(tokens: np.ndarray, payload: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    bucket = ((tokens >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, tokens, payload = bucket[order], tokens[order], payload[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for b, t, p in zip(bucket[np.concatenate([[0], cuts])] if len(bucket) else [], np.split(tokens, cuts), np.split(payload, cuts)):
        yield int(b), t, p


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return at, np.diff(np.concatenate([at, [len(values)]]))


_DIGEST = np.dtype([("id", "<i8"), ("n", "<i4"), ("made", "<i4"), ("shared", "<i4"), ("k1", "<i8"), ("k2", "<i8"), ("hash", "<i8")])
_FIRST = "bucket long, batch long, digest binary, tokens binary, rows binary"


def _first_pass(width: int, buckets: int):
    """Rows of (bucket, batch, digest of its documents) and of (bucket, batch, hashes, row of each in the batch)."""

    def run(batches):
        for piece in slices(batches, _BATCH, 4 << 20):
            ids = np.asarray(piece.column(0), dtype=np.int64)
            digest = np.zeros(len(ids), dtype=_DIGEST)
            digest["id"], digest["hash"] = ids, np.asarray(piece.column(2), dtype=np.int64)
            sets = _sets(piece, width)
            top = np.uint64(_SAMPLE) << np.uint64(58)
            part, row = [], []
            for i, s in enumerate(sets):
                low = s[: np.searchsorted(s, top)]
                digest["n"][i], digest["made"][i] = len(s), len(low)
                digest["k1"][i], digest["k2"][i] = _key(s)
                part.append(low)
                row.append(np.full(len(low), i, dtype=np.uint16))
            tokens, rows = np.concatenate(part), np.concatenate(row)
            order = np.argsort(tokens, kind="stable")
            tokens, rows = tokens[order], rows[order]
            at, count = _runs(tokens)
            here = np.repeat(count > 1, count)
            digest["shared"] = np.bincount(rows[here], minlength=len(ids))
            once, rows = tokens[at], np.where(count > 1, _MANY, rows[at]).astype(np.uint16) if len(at) else rows
            batch = _batch_id(ids, digest["k1"], digest["k2"])
            out = [(batch % buckets, batch, digest.tobytes(), None, None)]
            out += [(b, batch, None, t.tobytes(), r.tobytes()) for b, t, r in _by_bucket(once, rows, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "batch", "digest", "tokens", "rows"])

    return run


def _count_shared(group: pd.DataFrame) -> pd.DataFrame:
    """For each batch, how many of a row's hashes other batches have too; digests pass."""
    blobs = group[group.tokens.notna()]
    keep = group[group.digest.notna()][["batch", "digest"]].assign(rows=None, counts=None)
    if blobs.empty:
        return keep
    tokens = [np.frombuffer(t, dtype=np.uint64) for t in blobs.tokens]
    rows = np.concatenate([np.frombuffer(r, dtype=np.uint16) for r in blobs.rows])
    batch = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    order = np.argsort(np.concatenate(tokens), kind="stable")
    at, count = _runs(np.concatenate(tokens)[order])
    hit = order[np.repeat(count > 1, count)]
    hit = hit[rows[hit] != _MANY]
    pairs, counts = np.unique(batch[hit] * 65536 + rows[hit], return_counts=True)
    ids, out = blobs.batch.to_numpy(), []
    del tokens, order
    give_back()
    where, row = pairs >> 16, (pairs & 0xFFFF).astype(np.uint16)
    for start, length in zip(*_runs(where)):
        cut = slice(start, start + length)
        out.append((ids[where[start]], None, row[cut].tobytes(), counts[cut].astype(np.uint16 if counts.max() < 65536 else np.uint32).astype(np.uint32).tobytes()))
    return pd.concat([keep, pd.DataFrame(out, columns=["batch", "digest", "rows", "counts"])]) if out else keep


_DOCS = "id long, n int, k1 long, k2 long, hash long, alive boolean"


def _decide(percent: int):
    """Add up the counts of one batch, and say which of its documents may have a partner."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        digests = group.digest.dropna()
        if digests.empty:
            raise RuntimeError("a batch was made twice with different rows; give the operator a table that is scanned in a fixed order")
        digest = np.frombuffer(digests.iloc[0], dtype=_DIGEST).copy()
        for rows, counts in group[["rows", "counts"]].dropna().itertuples(index=False):
            digest["shared"][np.frombuffer(rows, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.uint32).astype(np.int32)
        can_miss = digest["n"] - least_overlap(digest["n"], percent)
        alive = (digest["n"] > 0) & (digest["shared"] >= digest["made"] - can_miss)
        out = pd.DataFrame({k: digest[k] for k in ("id", "n", "k1", "k2", "hash")}).assign(alive=alive)
        return pd.concat([out] * len(digests)) if len(digests) > 1 else out  # equal batches of repeated rows

    return run


_SETS = "batch long, ids binary, weights binary, sizes binary, tokens binary"


def _set_rows(width: int):
    """One row per batch: ids, class sizes, set sizes and all hashes, one set after the other."""

    def run(batches):
        for piece in slices(batches, 1024, 2 << 20):
            ids, weights, k1, k2 = (np.asarray(piece.column(i), dtype=np.int64) for i in (0, 2, 3, 4))
            sets = _sets(piece, width)
            # equal hashes of other texts with the same id
            own = [i for i, s in enumerate(sets) if _key(s) == (k1[i], k2[i])]
            if not own:
                continue
            ids, weights, sets = ids[own], weights[own], [sets[i] for i in own]
            row = (_batch_id(ids), ids.tobytes(), weights.tobytes(), np.array([len(s) for s in sets], dtype=np.int64).tobytes(), np.concatenate(sets).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([c], type=pa.int64() if not i else pa.binary()) for i, c in enumerate(row)], names=["batch", "ids", "weights", "sizes", "tokens"])

    return run


def _unpack(row) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(b, dtype=k) for b, k in ((row["ids"], "<i8"), (row["weights"], "<i8"), (row["sizes"], "<i8"), (row["tokens"], "<u8")))


_BLOBS = "bucket long, batch long, tokens binary, counts binary, least binary"


def _deal(buckets: int):
    """Each distinct hash of a batch once, with its count there and the least document that has it."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids, _, sizes, tokens = _unpack(row)
                owner = np.repeat(ids, sizes)
                order = np.lexsort((owner, tokens))
                tokens, owner = tokens[order], owner[order]
                at, count = _runs(tokens)
                values = np.stack([count, owner[at]], axis=1) if len(at) else np.zeros((0, 2), np.int64)
                out += [(b, row["batch"], t.tobytes(), v[:, 0].tobytes(), v[:, 1].tobytes()) for b, t, v in _by_bucket(tokens[at], values, buckets)]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=k) for i, k in enumerate(kinds)], names=["bucket", "batch", "tokens", "counts", "least"])

    return run


def _lead(group: pd.DataFrame) -> pd.DataFrame:
    """Answer each batch for its hashes that occur in two sets at least: total count, and the least document of all."""
    parts = [tuple(np.frombuffer(b, dtype=k) for b, k in zip(r, ("<u8", "<i8", "<i8"))) for r in group[["tokens", "counts", "least"]].itertuples(index=False)]
    tokens, counts, leader = (np.concatenate(x) for x in zip(*parts))
    batch = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(tokens, kind="stable")
    tokens, counts, leader, batch = tokens[order], counts[order], leader[order], batch[order]
    at, length = _runs(tokens)
    total, first = np.add.reduceat(counts, at), np.minimum.reduceat(leader, at)
    keep = np.flatnonzero(np.repeat(total > 1, length))
    of = np.repeat(np.arange(len(at)), length)[keep]
    order = np.argsort(batch[keep], kind="stable")
    keep, of = keep[order], of[order]
    ids, out = group.batch.to_numpy(), []
    for start, n in zip(*_runs(batch[keep])):
        cut = slice(start, start + n)
        out.append((ids[batch[keep][start]], tokens[keep][cut].tobytes(), total[of][cut].tobytes(), first[of][cut].tobytes()))
    return pd.DataFrame(out, columns=["batch", "found", "counts", "least"])


_MEMBERS = "leader long, id long, weight long, n long, leaders binary, tokens binary"


def _members(percent: int):
    """A row for each document and leader under which it meets others: its size, all its leaders, its shared hashes."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group[group.ids.notna()]
        found = group[group.found.notna()]
        out = []
        if len(rows) and len(found):
            shared = np.concatenate([np.frombuffer(b, dtype="<u8") for b in found.found])
            order = np.argsort(shared)
            shared = shared[order]
            counts = np.concatenate([np.frombuffer(b, dtype="<i8") for b in found.counts])[order]
            first = np.concatenate([np.frombuffer(b, dtype="<i8") for b in found.least])[order]
            for row in rows.to_dict("records"):
                ids, weights, sizes, tokens = _unpack(row)
                ends = np.cumsum(sizes)
                for id_, weight, n, to in zip(ids, weights, sizes, ends):
                    own = tokens[to - n : to]
                    at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
                    at = at[shared[at] == own]
                    spare = len(at) - least_overlap(n, percent)
                    if spare < 0:
                        continue
                    prefix = at[np.lexsort((shared[at], counts[at]))[: spare + 1]]
                    leaders = np.unique(first[prefix])
                    out += [(leader, id_, weight, n, leaders.tobytes(), shared[at].tobytes()) for leader in leaders.tolist()]
        return pd.DataFrame(out, columns=["leader", "id", "weight", "n", "leaders", "tokens"])

    return run


class _Tree:
    """Nodes over documents in a given order, level by level: bits ORed, sizes as ranges, common earlier leaders ANDed."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, early: np.ndarray):
        self.levels = [(bits, sizes, sizes, early)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, e = self.levels[-1]
            cuts = np.arange(0, len(low), _FAN)
            self.levels.append((np.bitwise_or.reduceat(b, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.bitwise_and.reduceat(e, cuts)))


def _bit_rows(which: np.ndarray, column: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Packed 0/1 rows, 64 columns to a word."""
    out = np.zeros((rows, max(1, -(-columns // 64))), dtype=np.uint64)
    np.bitwise_or.at(out, (which, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return out


def _walk(x: _Tree, y: _Tree, same: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of documents that link, piece by piece: pairs of nodes are tested from the roots down."""
    depth = max(len(x.levels), len(y.levels)) - 1
    stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        lx, ly = min(level, len(x.levels) - 1), min(level, len(y.levels) - 1)
        (bx, lowx, highx, ex), (by, lowy, highy, ey) = x.levels[lx], y.levels[ly]
        if same:
            keep = i < j if level == 0 else i <= j
            i, j = i[keep], j[keep]
        near = (100 * highx[i] >= percent * lowy[j]) & (100 * highy[j] >= percent * lowx[i])
        i, j = i[near], j[near]
        apart = ~(ex[i] & ey[j]).any(axis=1)
        i, j = i[apart], j[apart]
        if not len(i):
            continue
        step = max(1, (1 << 20) // bx.shape[1])
        fits = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), step):
            a, b = i[at : at + step], j[at : at + step]
            common = np.bitwise_count(bx[a] & by[b]).sum(axis=1, dtype=np.int64)
            fits[at : at + step] = (100 + percent) * common >= percent * (lowx[a] + lowy[b])
        i, j = i[fits], j[fits]
        if level == 0:
            if len(i):
                yield i, j
            continue
        for at in range(0, len(i), 16384):
            a, b = i[at : at + 16384], j[at : at + 16384]
            # a tree that has reached its leaves waits for the other
            ka = a[:, None] if lx < level else a[:, None] * _FAN + np.arange(_FAN)
            kb = b[:, None] if ly < level else b[:, None] * _FAN + np.arange(_FAN)
            na, nb = len(x.levels[min(level - 1, len(x.levels) - 1)][1]), len(y.levels[min(level - 1, len(y.levels) - 1)][1])
            pa_, pb = np.broadcast_arrays(ka[:, :, None], kb[:, None, :])
            pa_, pb = pa_.reshape(-1), pb.reshape(-1)
            inside = (pa_ < na) & (pb < nb)
            stack.append((level - 1, pa_[inside], pb[inside]))


def _link_block(percent: int):
    """All links of one block or pair of blocks, as one row per linked document."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # rows equal in id and text have come as one class each
        group = group.drop_duplicates(["side", "id"]).sort_values(["side", "id"], ignore_index=True)
        n, ids, weights, side = (group[c].to_numpy() for c in ("n", "id", "weight", "side"))
        parts = [np.frombuffer(t, dtype="<u8") for t in group.tokens]
        which = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        tokens, column, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        twice = count > 1
        place = np.cumsum(twice) - 1
        keep = twice[column]
        bits = _bit_rows(which[keep], place[column[keep]], len(parts), int(twice.sum()))
        leader = group.leader.iloc[0]
        earlier = [x[x < leader] for x in (np.frombuffer(b, dtype="<i8") for b in group.leaders)]
        marks, column = np.unique(np.concatenate(earlier), return_inverse=True)
        early = _bit_rows(np.repeat(np.arange(len(earlier)), [len(e) for e in earlier]), column, len(parts), len(marks))
        # like documents next to each other: by least common hash, then size
        first = np.array([p[0] if len(p) else 0 for p in parts], dtype=np.uint64)
        trees, members = [], []
        for s in (0, 1):
            own = np.flatnonzero(side == s)
            own = own[np.lexsort((n[own], first[own]))]
            members.append(own)
            trees.append(_Tree(bits[own], n[own], early[own]) if len(own) else None)
        same = group["pair_same"].iloc[0]
        links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        if same:
            trees[1], members[1] = trees[0], members[0]
        if trees[0] is not None and trees[1] is not None:
            for i, j in _walk(trees[0], trees[1], same, percent):
                a, b = members[0][i], members[1][j]
                np.add.at(links, a, weights[b])
                np.add.at(links, b, weights[a])
                while True:  # hook roots until both ends of every link have one
                    ra, rb = root[a], root[b]
                    low = np.minimum(ra, rb)
                    if (ra == rb).all():
                        break
                    np.minimum.at(root, ra, low)
                    np.minimum.at(root, rb, low)
                    while (root[root] != root).any():
                        root = root[root]
        hit = links > 0
        del bits, early, trees, parts, group
        give_back()
        return pd.DataFrame({"id": ids[hit], "links": links[hit], "root": ids[root[hit]]})

    return run


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, n_links) for each row of ``docs``.

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of ``width``-word shingles. n_links counts the
    other rows a row links with, exact copies included; component_id is the least id reachable. Null and empty texts and
    texts without words have 0 shingles, no links and themselves as component. Shorter texts are one shingle. Ids are integers;
    rows with a null id are returned with a null component and take part in nothing. Rows that repeat an id are documents
    of their own with that id. ``docs`` may have any further columns; they are not looked at. It has to be a table scan or
    another frame that repeats its rows in the same order when a task is run again.
    """
    if not 40 <= percent <= 100 or percent * 64 <= (64 - _SAMPLE) * 100:
        raise ValueError("percent out of range")
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    null_ids = source.where("id is null")
    source = source.where("id is not null")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size * _SAMPLE // (64 * 5 * _TOKENS)
    source = source.withColumn("hash", F.xxhash64("text"))
    made = source.mapInArrow(_first_pass(width, buckets), _FIRST)
    counted = made.groupBy("bucket").applyInPandas(_count_shared, "batch long, digest binary, rows binary, counts binary")
    all_docs = written(counted.groupBy("batch").applyInPandas(_decide(percent), _DOCS), "digests")

    alive = all_docs.where("alive")
    # classes of equal sets go by numbers of their own, as an id may stand for several
    classes = alive.groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "hash")).alias("least"), F.count("*").alias("weight"))
    classes = classes.select("k1", "k2", "n", F.col("least.id").alias("rep"), F.col("least.hash").alias("hash"), "weight")
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    total = classes.agg(F.count("*"), F.sum("n")).first()
    buckets = 1 + (total[1] or 0) // _TOKENS
    texts = source.join(small(classes.select(F.col("rep").alias("id"), "hash", "node", "k1", "k2", "weight"), total[0]), ["id", "hash"])
    sets = written(texts.select("node", "text", "weight", "k1", "k2").mapInArrow(_set_rows(width), _SETS), "sets")
    answers = sets.mapInArrow(_deal(buckets), _BLOBS).groupBy("bucket").applyInPandas(_lead, "batch long, found binary, counts binary, least binary")
    members = written(
        sets.unionByName(answers, allowMissingColumns=True).groupBy("batch").applyInPandas(_members(percent), _MEMBERS), "members"
    )

    per_leader = written(members.groupBy("leader").agg(F.count("*").alias("met")).where("met > 1"), "leaders")
    blocks = F.ceil(F.col("met") / _BLOCK).cast("int")
    met = members.join(small(per_leader.withColumn("blocks", blocks).drop("met"), per_leader.count()), "leader")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select(
        "leader", "id", "weight", "n", "leaders", "tokens", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("own") == F.col("other")).alias("pair_same"),
    )
    linked = written(met.groupBy("leader", "lo", "hi").applyInPandas(_link_block(percent), "id long, links long, root long"), "links")

    groups = components(linked, "id", "root")
    ranked = groups.join(small(classes.select("node", "rep"), total[0]), "node")
    least = ranked.groupBy("component").agg(F.min("rep").alias("least"))
    groups = written(groups.join(least, "component").select("node", "least"), "groups")
    links = linked.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    reps = classes.join(groups, "node", "left").join(links, "node", "left")
    reps = reps.select("k1", "k2", "n", F.coalesce("least", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    found = all_docs.join(small(reps, total[0]), ["k1", "k2", "n"], "left")
    out = found.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("alive"), F.col("component")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("alive"), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
    lost = null_ids.mapInArrow(_sizes(width), f"id long, n long").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(lost)


def _sizes(width: int):
    def run(batches):
        for piece in slices(batches, _BATCH):
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array([len(s) for s in _sets(piece, width)], type=pa.int64())], names=["id", "n"])

    return run


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group; of rows that repeat an id, the one with the least text stays.

    Rows with a null id stay.
    """
    groups = jaccard_groups(docs, id_col, text_col, percent=percent)
    kept = written(groups.where(f"`{id_col}` = component_id").select(F.col(f"`{id_col}`").alias("kept_id")).distinct(), "kept")
    mark = fresh("kept_id", docs.columns)
    kept = small(kept.select(F.col("kept_id").alias(mark)), kept.count())
    named, nameless = docs.where(F.col(f"`{id_col}`").isNotNull()), docs.where(F.col(f"`{id_col}`").isNull())
    stay = named.join(kept, named[f"`{id_col}`"].cast("long") == F.col(mark), "left_semi")
    repeated = written(stay.groupBy(F.col(f"`{id_col}`").alias(mark)).agg(F.count("*").alias("n")).where("n > 1").select(mark), "repeated")
    if repeated.isEmpty():
        return stay.unionByName(nameless)
    twice = stay.join(repeated, stay[f"`{id_col}`"] == repeated[mark], "left_semi")
    once = stay.join(repeated, stay[f"`{id_col}`"] == repeated[mark], "left_anti")
    key = F.struct(F.col(f"`{text_col}`"), *[F.col(f"`{c}`").cast("string") for c in docs.columns])
    first = twice.groupBy(F.col(f"`{id_col}`").alias(mark)).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), key).alias("row"))
    return once.unionByName(first.select("row.*")).unionByName(nameless)
