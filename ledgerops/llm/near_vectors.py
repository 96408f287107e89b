"""Near-duplicate vectors: a subspace pigeonhole join of unit vectors, exact for every pair at or above the cosine asked for.

Unit vectors with cosine >= c lie within a squared distance of 2 - 2 c. After a rotation the space is split into blocks of few dimensions, each with its
share of that budget in proportion to its dimensions. A pair within the whole budget is within the share of one block at least, so the union of the blocks'
range joins holds every pair; the candidates are then verified by their full vectors in double precision.

Each block is cut into cells by medians of a bounded sample (the cuts decide where work is done, never what is found). A vector lives in one cell of each
block and also visits those cells that its range reaches; of two cells that reach each other only one is visited. Cells with more than ``CELL`` vectors
are dealt into as many parts by the row's number, so a group of copies of any size spreads over many tasks. A task holds the inhabitants
of one part (about ``CELL``) and streams the visitors past them in matrix products; it gives sums and one link to the least
neighbour per vector, never pairs. A pair within the share of several blocks counts in the first of them.

Equal vectors are first joined to one class, whose size counts. Where vectors are spread evenly over many dimensions, no exact join can leave out most pairs of cells:
copies of a vector then grow with the number of cells it reaches, and work with the square of the vectors (at matrix-product speed).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerops.llm.components import components
from ledgerops.llm.tables import give_back, slices, written

#: Blocks of a space, vectors of a cell's part (about), rows of the sample that cuts the cells, and the most cells of a block.
BLOCKS, CELL, SAMPLE, MOST_CELLS = 4, 16_384, 20_000, 4096
#: Rows that one matrix product compares with each other.
_TILE = 2048
_SEED = 12


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task and run."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def bounds(dims: int) -> list[tuple[int, int]]:
    """First and last + 1 dimension of each block."""
    edges = np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    """Packed vectors of ``dims`` numbers each as rows of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dims).astype(np.float64)


def _packer(kind: str):
    """Vectors as bytes, in single precision where the column has no more; null for those that link with nothing."""

    def pack(batches):
        for piece in slices(batches, 4096, text=2):
            column = piece.column(1).cast(pa.large_list(pa.float64()))
            values, offsets = np.asarray(column.values.fill_null(np.nan)), np.asarray(column.offsets)
            out = []
            for i, there in enumerate(column.is_valid().to_pylist()):
                x = values[offsets[i] : offsets[i + 1]]
                good = there and len(x) and np.isfinite(x).all() and x.any()
                out.append(np.ascontiguousarray(x + 0.0, dtype=kind).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, type=pa.binary())], names=["id", "vec"])

    return pack


class Cells:
    """The cells of every block of one space: medians of a sample, split again where many vectors are."""

    def __init__(self, sample: np.ndarray, wanted: int):
        self.rotation, self.blocks = rotation(sample.shape[1]), []
        turned = units(sample) @ self.rotation
        for lo, hi in bounds(sample.shape[1]):
            leaves = [(turned[:, lo:hi], np.full(hi - lo, -np.inf), np.full(hi - lo, np.inf))]
            while len(leaves) < wanted:
                at = max(range(len(leaves)), key=lambda i: len(leaves[i][0]))
                rows, low, high = leaves[at]
                spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) > 1 else np.zeros(1)
                axis = int(spread.argmax())
                middle = float(np.median(rows[:, axis])) if spread[axis] > 0 else 0.0
                left = rows[:, axis] <= middle
                if spread[axis] <= 0 or left.all():
                    break  # equal rows: the parts of the cell will do
                below, above = high.copy(), low.copy()
                below[axis] = above[axis] = middle
                leaves[at : at + 1] = [(rows[left], low, below), (rows[~left], above, high)]
            self.blocks.append((np.array([x[1] for x in leaves]), np.array([x[2] for x in leaves])))

    def reach(self, turned: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of each row, and its squared distance to every cell of the block."""
        lo, hi = bounds(turned.shape[1])[block]
        low, high = self.blocks[block]
        part = turned[:, lo:hi]
        away = np.zeros((len(part), len(low)))
        inside = np.ones((len(part), len(low)), dtype=bool)
        for k in range(hi - lo):
            x = part[:, k : k + 1]
            away += np.square(np.maximum(low[:, k] - x, 0) + np.maximum(x - high[:, k], 0))
            inside &= (x > low[:, k]) & (x <= high[:, k])
        return inside.argmax(axis=1), away


def _counter(cells: dict[int, Cells], kind: str):
    def count(batches):
        total: dict[tuple[int, int, int], int] = {}
        for piece in slices(batches, 4096, text=1):
            dims = np.asarray(piece.column(2))
            for d in np.unique(dims).tolist():
                turned = units(_matrix(piece.column(1).filter(pa.array(dims == d)), d, kind)) @ cells[d].rotation
                for b in range(len(cells[d].blocks)):
                    home, n = np.unique(cells[d].reach(turned, b)[0], return_counts=True)
                    for h, m in zip(home.tolist(), n.tolist()):
                        total[d, b, h] = total.get((d, b, h), 0) + m
        if total:
            columns = [pa.array([k[i] for k in total], type=pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(total.values()), type=pa.int64())], names=["dims", "block", "cell", "n"])

    return count


_SENT = "slot bigint, dims bigint, block bigint, home boolean, node bigint, n bigint, vec binary"


def _sender(cells: dict[int, Cells], slots: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], budget: float, kind: str):
    """Rows of (slot, dims, block, home, node, n, vec): each vector where it lives and where it visits."""

    def send(batches):
        for piece in slices(batches, 1024, text=1):
            dims, node = np.asarray(piece.column(2)), np.asarray(piece.column(3))
            for d in np.unique(dims).tolist():
                own = piece.filter(pa.array(dims == d))
                number = node[dims == d]
                turned = units(_matrix(own.column(1), d, kind)) @ cells[d].rotation
                for b, (lo, hi) in enumerate(bounds(d)):
                    first, parts = slots[d, b]
                    home, away = cells[d].reach(turned, b)
                    total = int(parts.sum())
                    cell_of = np.repeat(np.arange(len(parts)), parts)
                    lives = first[home] - first[0] + number % parts[home]
                    near = (away <= budget * (hi - lo) / d + 1e-9)[:, cell_of]
                    # of two slots, the one with the smaller number is visited if their sum is even, else the other one
                    mine, other = lives[:, None], np.arange(total)[None, :]
                    near &= np.where((mine + other) % 2 == 0, other < mine, other > mine)
                    near[np.arange(len(lives)), lives] = True
                    row, slot = np.nonzero(near)
                    for at in range(0, len(row), 4096):
                        r, s = row[at : at + 4096], slot[at : at + 4096]
                        columns = [pa.array(s + first[0]), pa.array(np.full(len(r), d)), pa.array(np.full(len(r), b)), pa.array(s == lives[r]), pa.array(number[r])]
                        yield pa.RecordBatch.from_arrays([*columns, own.column(4).take(pa.array(r)), own.column(1).take(pa.array(r))], names=["slot", "dims", "block", "home", "node", "n", "vec"])

    return send


class _Part:
    """The inhabitants of one part of a cell, past which visitors stream."""

    def __init__(self, dims: int, block: int, cosine: float, kind: str):
        self.dims, self.block, self.cosine, self.kind = dims, block, cosine, kind
        self.turn = rotation(dims)
        self.blocks = bounds(dims)
        self.share = [(2 - 2 * cosine) * (hi - lo) / dims for lo, hi in self.blocks]
        self.pieces: list[tuple] = []

    def rows(self, vec: pa.Array, node: np.ndarray, n: np.ndarray) -> tuple:
        unit = units(_matrix(vec, self.dims, self.kind))
        turned = unit @ self.turn
        lo, hi = self.blocks[self.block]
        low = turned[:, lo:hi].astype(np.float32)
        return unit, turned, low, (low * low).sum(axis=1), node, n

    def settle(self) -> None:
        """All inhabitants are there."""
        joined = [np.concatenate(x) for x in zip(*self.pieces)]
        self.pieces = []
        self.unit, self.turned, self.low, self.norm, self.node, self.n = joined
        self.links, self.root = np.zeros(len(self.node), dtype=np.int64), np.arange(len(self.node))

    def _linked(self, a: tuple, b: tuple, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which of the rows r of a and c of b link and count in this block."""
        ok = a[0][r] @ b[0][c].T >= self.cosine
        unsure = np.zeros_like(ok)
        for k in range(self.block + 1):
            lo, hi = self.blocks[k]
            x, y = a[1][r, lo:hi], b[1][c, lo:hi]
            gap = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T) - self.share[k]
            unsure |= np.abs(gap) < 1e-9
            ok &= (gap <= 1e-10) if k == self.block else (gap > 1e-10)
        for i, j in zip(*np.nonzero(unsure)):  # at the edge of a share every task must decide alike, whatever the shape of its product
            x, y = a[1][r[i]], b[1][c[j]]
            gaps = [float(np.square(x[lo:hi] - y[lo:hi]).sum()) - s for (lo, hi), s in zip(self.blocks, self.share)]
            ok[i, j] = float((a[0][r[i]] * b[0][c[j]]).sum()) >= self.cosine and next((k for k, g in enumerate(gaps) if g <= 1e-10), -1) == self.block
        return ok

    def _hook(self, roots: np.ndarray, lower: np.ndarray) -> None:
        """The groups of ``roots`` also belong to those of ``lower``."""
        np.minimum.at(self.root, roots, lower)
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]

    def _join(self, ok: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Give linked rows one root: ``mine`` are inhabitants, ``theirs`` roots of the others (or past the last, for none); gives their new roots."""
        none = len(self.root)
        while True:
            at, had = self.root[mine], theirs < none
            theirs[had] = self.root[theirs[had]]
            low = np.minimum(np.where(ok, at[:, None], none).min(axis=0), theirs)
            new = np.minimum(np.where(ok, low[None, :], none).min(axis=1), at)
            if (new == at).all() and (low == theirs).all():
                return theirs
            self._hook(np.concatenate([at, theirs[had]]), np.concatenate([new, low[had]]))
            theirs = low

    def compare(self, other: tuple, at: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Links of ``other`` with the inhabitants, and the inhabitant each joins (-1: none). ``at``: they are inhabitants themselves, from this row on."""
        me = (self.unit, self.turned)
        links, lead = np.zeros(len(other[4]), dtype=np.int64), np.full(len(other[4]), len(self.root))
        for lo in range(0, len(self.node) if at is None else at + len(other[4]), _TILE):
            hi = min(lo + _TILE, len(self.node))
            near = self.norm[lo:hi, None] + other[3][None, :] - 2 * (self.low[lo:hi] @ other[2].T) <= self.share[self.block] + 1e-4
            if at is not None:
                near &= np.arange(lo, hi)[:, None] < np.arange(at, at + len(other[4]))[None, :]
            r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(r):
                continue
            ok = self._linked(me, other, r + lo, c)
            if at is not None:
                ok &= (r + lo)[:, None] < (c + at)[None, :]
            i, j = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            if not len(i):
                continue
            ok, r, c = ok[np.ix_(i, j)], r[i] + lo, c[j]
            self.links[r] += ok @ other[5][c]
            links[c] += self.n[r] @ ok
            lead[c] = self._join(ok, r, lead[c] if at is None else self.root[c + at])
        return links, np.where(links > 0, lead, -1)


_FOUND = "node bigint, links bigint, lead bigint"


def _result(node: np.ndarray, links: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(x[some], type=pa.int64()) for x in (node, links, lead)], names=["node", "links", "lead"])


def _joiner(cosine: float, kind: str):
    """Rows by slot, inhabitants first, to (node, links counted here, a node it is joined with)."""

    def join(batches):
        part: _Part | None = None
        slot, open_ = None, False

        def close():
            if part is None:
                return
            if open_ and not part.pieces:  # nobody lives there
                return
            if open_:
                settled()
            yield _result(part.node, part.links, part.node[part.root])

        def settled():
            part.settle()
            for at in range(0, len(part.node), _TILE):
                to = min(at + _TILE, len(part.node))
                links, _ = part.compare((part.unit[at:to], part.turned[at:to], part.low[at:to], part.norm[at:to], part.node[at:to], part.n[at:to]), at)
                part.links[at:to] += links

        for piece in slices(batches, _TILE, text=6):
            of, home = np.asarray(piece.column(0)), np.asarray(piece.column(3).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (home[1:] != home[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
                if of[lo] != slot:
                    yield from close()
                    part, slot, open_ = _Part(piece.column(1)[lo].as_py(), piece.column(2)[lo].as_py(), cosine, kind), of[lo], True
                    give_back()
                rows = part.rows(piece.column(6).slice(lo, hi - lo), np.asarray(piece.column(4))[lo:hi], np.asarray(piece.column(5))[lo:hi])
                if home[lo]:
                    part.pieces.append(rows)
                    continue
                if open_:
                    if not part.pieces:
                        continue
                    settled()
                    open_ = False
                links, lead = part.compare(rows)
                yield _result(rows[4], links, part.node[np.maximum(lead, 0)])
        yield from close()

    return join


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """Per row of ``vectors``: (id, n_links, component_id, kept).

    Two vectors link if their cosine in double precision is at least ``cosine`` (above 0, below 1). ``n_links`` counts the other rows a row links with,
    ``component_id`` is the least id reachable, ``kept`` tells whether that is the row's own. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing, and so do vectors of different lengths. Rows that repeat an id are vectors of their own. A row with a null id counts as a
    neighbour; its component has the least id that is there, or null, and it is kept if there is none. An empty table gives no rows; other columns are not looked at.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    raw = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.lit("").alias("t"))
    number, width = ("<f4", 4) if dict(vectors.dtypes)[vector_col] == "array<float>" else ("<f8", 8)
    packed = raw.mapInArrow(_packer(number), f"id {kind}, vec binary").withColumn("key", F.unhex(F.sha2("vec", 256)))
    members = written(packed.select("id", "key"), "vector-members")
    classes = packed.where("vec is not null").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", (F.octet_length("vec") / width).cast("bigint")), "vector-classes")
    nodes = classes.select("node", "vec", "dims", "n")
    # how many vectors of each length; a bounded sample of each cuts its cells
    sizes = {r["dims"]: r["count"] for r in nodes.groupBy("dims").count().collect()}
    cells = {}
    for d, count in sizes.items():
        some = nodes.where(F.col("dims") == d).select("vec")
        some = some if count <= SAMPLE else some.sample(0.9 * SAMPLE / count, _SEED).limit(SAMPLE)
        sample = np.frombuffer(b"".join(bytes(r["vec"]) for r in some.collect()), dtype=number).reshape(-1, d).astype(np.float64)
        cells[d] = Cells(sample, max(1, min(MOST_CELLS, len(sample), -(-count // CELL))))
    counted = nodes.select(F.lit(0).alias("z"), "vec", "dims").mapInArrow(_counter(cells, number), "dims bigint, block bigint, cell bigint, n bigint")
    lived = {(r["dims"], r["block"], r["cell"]): r["n"] for r in counted.groupBy("dims", "block", "cell").agg(F.sum("n").alias("n")).collect()}
    slots, used = {}, 0
    for d in cells:
        for b, (low, _) in enumerate(cells[d].blocks):
            parts = np.array([max(1, -(-lived.get((d, b, c), 0) // CELL)) for c in range(len(low))], dtype=np.int64)
            slots[d, b] = (used + np.cumsum(parts) - parts, parts)
            used += int(parts.sum())
    sent = nodes.select(F.lit(0).alias("z"), "vec", "dims", "node", "n").mapInArrow(_sender(cells, slots, 2 - 2 * cosine, number), _SENT)
    sent = sent.repartitionByRange(max(1, used), "slot").sortWithinPartitions("slot", F.desc("home"))
    found = written(sent.mapInArrow(_joiner(cosine, number), _FOUND), "vector-links")
    reached = components(found.where("node <> lead"), "node", "lead").withColumnRenamed("node", "_node")
    known = classes.select("key", "node", "first", "n").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    known = known.join(reached, F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "node"))
    known = written(known.select("key", "component", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector-known")
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(least, "component").select(F.col("key").alias("_key"), "n_links", "component_id")
    out = members.join(known, F.col("key") == F.col("_key"), "left")
    alone = F.col("_key").isNull()
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
