"""Near duplicates among embeddings by a subspace pigeonhole join.

Unit vectors with a cosine of at least t lie within the squared distance D = 2 - 2 t. They are
rotated so that their variance falls from coordinate to coordinate, and the coordinates are
dealt to ``BLOCKS`` blocks. Each block gets a part of D in proportion to its variance. If two
vectors are within D, they are within the part in at least one block.

So each block is a range join: a grid over the block's two leading coordinates, as wide as
the block's distance, sends each vector to its cell and to the neighbours on one side. Pairs
within the block's distance are candidates, and the cosine of each is computed exactly in
double precision. A pair counts in the first block where it is within the part, so none
counts twice and no pair leaves its task: tasks return numbers of links by vector, and links
that span what they have connected.

Equal vectors are one vector with a weight. Cells of more than ``cell`` vectors are divided
into parts, and every pair of parts is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import table
from promptloom.llm.components import components
from promptloom.llm.registry import query
from promptloom.operators.prefix import number_rows
from promptloom.session import materialise, ship_package

LEAST_COSINE, BLOCKS, CELL, SAMPLE = 0.9, 4, 16_000, 4096
_PROBES = 500  # rows that are compared with a cell's residents at once
_SLACK = 1e-5  # more than the rounding of coordinates to single precision
_KEY = ("dims", "block", "x", "y", "part", "slice")


class Rotation:
    """Principal axes of a sample, dealt to blocks, with each block's part of the distance."""

    def __init__(self, sample: np.ndarray, far: float, blocks: int):
        spread, axes = np.linalg.eigh(sample.T @ sample / max(1, len(sample)) + 1e-6 * np.eye(sample.shape[1]))
        order = np.argsort(-spread, kind="stable")
        dealt = [order[b::blocks] for b in range(min(blocks, len(order)))]
        self.axes = axes[:, np.concatenate(dealt)]
        self.bounds = np.cumsum([0, *map(len, dealt)])
        shares = np.array([spread[d].sum() for d in dealt])
        self.parts = far * shares / shares.sum()

    def turn(self, unit: np.ndarray) -> np.ndarray:
        """Rotated vectors in single precision; a row's result does not depend on other rows."""
        turned = np.zeros_like(unit)
        for k in range(unit.shape[1]):
            turned += unit[:, k : k + 1] * self.axes[k]
        return turned.astype(np.float32).astype(np.float64)

    def cells(self, turned: np.ndarray, block: int) -> np.ndarray:
        start, stop = self.bounds[block : block + 2]
        lead = turned[:, start : min(start + 2, stop)]
        found = np.floor(lead / np.sqrt(self.parts[block] + 2 * _SLACK)).astype(np.int64)
        return found if found.shape[1] == 2 else np.column_stack([found, np.zeros(len(found), np.int64)])

    def within(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """For pairs of rows and every block whether the pair is within the block's part."""
        square = (one - other) ** 2
        return np.stack([square[:, a:b].sum(1) for a, b in zip(self.bounds, self.bounds[1:])], 1) <= self.parts + _SLACK


def _unit(rows: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(rows), np.float64).reshape(-1, dims)
    norms = np.sqrt((raw * raw).sum(1))
    return raw, norms, raw / norms[:, None]


def _distinct(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, dims, digest, bytes`` of usable vectors; the bytes are doubles."""
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, data = [], [], []
            for number, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0  # no minus zero
                with np.errstate(over="ignore"):
                    if v.values.null_count or not len(own) or not np.isfinite(own).all() or not np.any(own):
                        continue
                    size = float((own * own).sum())
                    if not 0 < size < np.inf:  # out of the range of squares: scale by a power of two
                        own = np.ldexp(own, -int(np.frexp(np.abs(own).max())[1]))
                ids.append(number)
                dims.append(len(own))
                data.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int64()), pa.array(data, pa.binary())], ["id", "dims", "bytes"])

    return rows.mapInArrow(work, "id long, dims long, bytes binary").withColumn("digest", F.unhex(F.md5("bytes")))


def _counted_cells(nodes: DataFrame, turns, cell: int) -> dict[tuple, int]:
    """Number of parts of each cell that needs more than one; at most blocks * rows / cell cells."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims):
                rotation = turns.value[int(d)]
                turned = rotation.turn(_unit(batch.column(1).filter(pa.array(dims == d)).to_pylist(), int(d))[2])
                for block in range(len(rotation.parts)):
                    cells, counts = np.unique(rotation.cells(turned, block), axis=0, return_counts=True)
                    out += [(int(d), block, int(x), int(y), int(n)) for (x, y), n in zip(cells, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["dims", "block", "x", "y", "n"])

    counts = nodes.select("dims", "bytes").mapInArrow(work, "dims long, block long, x long, y long, n long")
    large = counts.groupBy("dims", "block", "x", "y").agg(F.sum("n").alias("n")).where(F.col("n") > cell)
    return {tuple(row[:4]): -(-row[4] // cell) for row in large.toLocalIterator()}


def _dealt(nodes: DataFrame, turns, parts) -> DataFrame:
    """Each vector as a resident (role 0) of its cells and as a probe (role 1) of neighbours."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                dims, out, rows = piece.column(1).to_numpy(), [], []
                numbers = piece.column(0).to_numpy()
                for d in np.unique(dims):
                    rotation, own = turns.value[int(d)], np.flatnonzero(dims == d)
                    turned = rotation.turn(_unit(piece.column(2).take(pa.array(own)).to_pylist(), int(d))[2])
                    for block in range(len(rotation.parts)):
                        for i, (x, y) in zip(own.tolist(), rotation.cells(turned, block).tolist(), strict=True):
                            key, number = (int(d), block, x, y), int(numbers[i])
                            many = parts.value.get(key, 1)
                            mine = number % many
                            out += [(*key, mine, s, 0) for s in range(many)]
                            out += [(*key, p, number // many % many, 1) for p in range(mine + 1, many)]
                            for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1)):
                                near = (int(d), block, x + dx, y + dy)
                                many_near = parts.value.get(near, 1)
                                out += [(*near, p, number // many_near % many_near, 1) for p in range(many_near)]
                            rows += [i] * (len(out) - len(rows))
                taken = piece.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([r[k] for r in out], pa.int64()) for k in range(7)), taken.column(0), taken.column(2), taken.column(3)],
                    [*_KEY, "role", "node", "bytes", "weight"],
                )

    columns = ", ".join(f"{k} long" for k in (*_KEY, "role", "node"))
    return nodes.select("node", "dims", "bytes", "weight").mapInArrow(work, f"{columns}, bytes binary, weight long")


class _Task:
    """The residents of one part of a cell, and what they have been linked with."""

    def __init__(self, key: tuple, rotation: Rotation, least: float):
        self.key, self.rotation, self.least = key, rotation, least
        self.rows: list[tuple[int, bytes, int]] = []
        self.home = self.columns = None

    def settle(self, counts: dict, links: list) -> None:
        """All residents are there: compare them with each other, once."""
        self.home = self._made(self.rows)
        self.rows = []
        block = self.home[5]
        ones = np.ones((len(block), 1), np.float32)
        self.columns = np.vstack([block.T, ones.T, (block**2).sum(1)])
        if self.key[5] == 0:
            self._compare(self.home, True, counts, links)

    def probe(self, rows: list[tuple[int, bytes, int]], counts: dict, links: list) -> None:
        if len(self.home[0]):
            self._compare(self._made(rows), False, counts, links)

    def _made(self, rows: list[tuple[int, bytes, int]]) -> tuple:
        raw, norms, unit = _unit([r[1] for r in rows], self.key[0])
        start, stop = self.rotation.bounds[self.key[1] : self.key[1] + 2]
        turned = self.rotation.turn(unit)
        return np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), raw, norms, turned, turned[:, start:stop].astype(np.float32)

    def _compare(self, given: tuple, same: bool, counts: dict, links: list) -> None:
        for at in range(0, len(given[0]), _PROBES):
            self._compare_some([part[at : at + _PROBES] for part in given], at if same else None, counts, links)

    def _compare_some(self, given: list, offset: int | None, counts: dict, links: list) -> None:
        """Compare rows with the residents; with an offset they are residents from there on."""
        nodes, weights, raw, norms, turned, block = given
        home_nodes, home_weights, home_raw, home_norms, home_turned, home_block = self.home
        # Squared distances in one product: |a|^2 + |b|^2 - 2 a b.
        ones = np.ones((len(block), 1), np.float32)
        left = np.hstack([-2 * block, (block**2).sum(1, keepdims=True), ones])
        squares = left @ self.columns
        places = np.flatnonzero(squares <= np.float32(self.rotation.parts[self.key[1]] + 2 * _SLACK))
        a, b = np.divmod(places, len(home_nodes))
        if offset is not None:
            later = b > a + offset
            a, b = a[later], b[later]
        for at in range(0, len(a), 20_000):
            i, j = a[at : at + 20_000], b[at : at + 20_000]
            first = self.rotation.within(turned[i], home_turned[j])
            mine = first[:, self.key[1]] & ~first[:, : self.key[1]].any(1)
            i, j = i[mine], j[mine]
            linked = (raw[i] * home_raw[j]).sum(1) / (norms[i] * home_norms[j]) >= self.least
            i, j = i[linked], j[linked]
            for own, other in ((nodes[i], home_weights[j]), (home_nodes[j], weights[i])):
                found, spot = np.unique(own, return_inverse=True)
                for node, n in zip(found.tolist(), np.bincount(spot, other).astype(np.int64).tolist(), strict=True):
                    counts[node] = counts.get(node, 0) + n
            links += _spanning(nodes[i].tolist(), home_nodes[j].tolist())


def _spanning(one: list[int], other: list[int]) -> list[tuple[int, int]]:
    """Those of the links that connect what earlier ones have not."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kept = []
    for a, b in zip(one, other, strict=True):
        x, y = top(a), top(b)
        if x != y:
            root[x] = y
            kept.append((a, b))
    return kept


def _joined(dealt: DataFrame, turns, least: float) -> DataFrame:
    """``a, b, n``: links with b, and numbers of links of a where b is null."""
    ordered = dealt.repartition(*_KEY).sortWithinPartitions(*_KEY, "role")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = None
        counts: dict[int, int] = {}
        links: list[tuple[int, int]] = []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
            rows = list(zip(*(batch.column(i).to_pylist() for i in (7, 8, 9)), strict=True))
            roles = batch.column(6).to_pylist()
            at = 0
            while at < len(keys):
                stop = at
                while stop < len(keys) and stop - at < _PROBES and (keys[stop], roles[stop]) == (keys[at], roles[at]):
                    stop += 1
                if task is None or task.key != keys[at]:
                    if task is not None and task.home is None:
                        task.settle(counts, links)
                    task = _Task(keys[at], turns.value[keys[at][0]], least)
                if roles[at] == 0:
                    task.rows += rows[at:stop]
                else:
                    if task.home is None:
                        task.settle(counts, links)
                    task.probe(rows[at:stop], counts, links)
                at = stop
            yield _result(counts, links)
            counts, links = {}, []
        if task is not None and task.home is None:
            task.settle(counts, links)
        yield _result(counts, links)

    return ordered.select(*_KEY, "role", "node", "bytes", "weight").mapInArrow(work, "a long, b long, n long")


def _result(counts: dict[int, int], links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*counts, *(x[0] for x in links)], pa.int64()),
            pa.array([*[None] * len(counts), *(x[1] for x in links)], pa.int64()),
            pa.array([*counts.values(), *[0] * len(links)], pa.int64()),
        ],
        ["a", "b", "n"],
    )


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE, blocks: int = BLOCKS, cell: int = CELL
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    Vectors link if their cosine in double precision is at least ``least`` (above -1). A null,
    empty or zero vector, one with null or non-finite components, and a row with a null id
    link with nothing. Vectors of different lengths do not link. Repeated rows and rows with
    equal ids are vectors of their own. The axes come from ``SAMPLE`` vectors (the choice
    affects costs only). An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    usable = materialise(_distinct(vectors, id_col, vector_col), "vectors")
    classes = usable.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    numbered = materialise(number_rows(classes.withColumn("every", F.lit(1)), ["every"], ["first", "digest"], "node").drop("every"), "classes")
    named = usable.join(numbered, "digest")
    nodes = materialise(named.where("id = first").select("node", "dims", "bytes", "weight").dropDuplicates(["node"]), "nodes")

    turns: dict[int, Rotation] = {}
    for (dims,) in nodes.select("dims").distinct().collect():
        sample = nodes.where(F.col("dims") == dims).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("bytes").collect()
        turns[dims] = Rotation(_unit([bytes(r[0]) for r in sample], dims)[2], 2 - 2 * least, blocks)
    sent = spark.sparkContext.broadcast(turns)
    parts = spark.sparkContext.broadcast(_counted_cells(nodes, sent, cell))
    found = materialise(_joined(_dealt(nodes, sent, parts), sent, least), "near")

    degrees = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    firsts = numbered.select(F.col("node").alias("root"), F.col("first").alias("component"))
    by_class = (
        numbered.join(degrees, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .join(firsts, "root")
        .select("digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component")
    )
    linked = usable.select("id", "digest").join(by_class, "digest").select("id", "n_links", "component", F.lit(True).alias("linked"))
    # Rows that link with nothing were left out; equal ids may stand on both sides.
    is_usable = _usable(vectors, id_col, vector_col)
    rest = is_usable.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(False).alias("linked"))
    return linked.unionByName(rest).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, usable`` by the same rule as in ``_distinct``."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0.0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.select("id", F.coalesce(usable, F.lit(False)).alias("usable"))


ORACLE = r"""
WITH RECURSIVE vec AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (
  SELECT r, vec_id, v, sqrt(list_sum([x * x for x in v])) AS norm FROM vec
  WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in v if x <> 0]) > 0),
link AS (
  SELECT x.r AS a, y.r AS b FROM usable x JOIN usable y ON x.r <> y.r AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.9),
reach AS (
  SELECT r AS a, r AS b FROM vec UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT x.vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(y.vec_id) AS component_id,
       x.vec_id IS NOT DISTINCT FROM min(y.vec_id) AS kept
FROM reach JOIN vec x ON x.r = reach.a JOIN vec y ON y.r = reach.b LEFT JOIN degree ON degree.a = reach.a
GROUP BY reach.a, x.vec_id"""


@query(ORACLE)
def op6_near_vectors(spark, sf_dir):
    """Links and component of every embedding."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
