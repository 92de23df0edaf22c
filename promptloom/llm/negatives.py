"""Hard negatives of embeddings by an inverted multi-index.

Vectors are split in two halves, and each half has a codebook of its own; a pair of codes is a
cell. For a query q, a row x in cell (i, j) scores at most

    q1 . c1[i] + |q1| r1[i]  +  q2 . c2[j] + |q2| r2[j]

with the codes' centres c and radii r (the largest distance of a row's half from its centre).
Cells are visited by falling bound, with a heap over the two sorted lists of half-score bounds
(multi-sequence). A search ends when its windows are certified: no cell that is left can hold a
row that belongs in a result. So results are exact, and the codebooks, which are fitted to
``SAMPLE`` vectors, decide costs only. Every row is indexed.

The index is dealt into shards of about ``SHARD_ROWS`` rows, by cell and then by a hash, so a
crowded cell spans several shards. A query first searches the shard with the highest bound.
What it finds there certifies most other shards; it goes to the rest only (``_routed``).

1. Positives: the best rows with the query's label.
2. Negatives: for each positive score s, the best rows of other labels between
   ``least``/100 * s and s.

Equal vectors with one label tie in every score, and ties go to the smaller id. So only the
first ids of such a group can be in any result (one more than positives or negatives are asked
for), and only they are indexed; anchors with equal vectors and labels are one query. Groups of
copies thus cost no more than one row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import stored, table
from promptloom.llm.registry import query
from promptloom.session import materialise, ship_package

POSITIVES, NEGATIVES, LEAST = 5, 5, 80
SCALE = 256
SAMPLE, ROUNDS = 8192, 8
CODES = 256  # most codes of a codebook: both, and a list of all cells, are sent to the tasks
SHARD_ROWS = 50_000
_MOST = 1 << 25  # a component from this on could bring a score beyond 64 bits
_EXACT = float(1 << 52)  # sums of whole numbers up to here are exact in floating point


@dataclass
class _Index:
    """Codebooks of both halves, and which cells each shard holds."""

    cut: int
    width: int
    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None
    shards: np.ndarray | None = None  # sorted, one per cell and shard
    cells: np.ndarray | None = None  # their (i, j)

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.cut], vectors[:, self.cut :]

    def codes(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half the nearest code of each vector, and the distance from it."""
        return [_nearest(half, centres) for half, centres in zip(self.halves(vectors), self.centres, strict=True)]

    def bounds(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each half and code the largest score that a row with this code can add, rounded up."""
        found = []
        for half, centres, radii in zip(self.halves(vectors), self.centres, self.radii, strict=True):
            norms = np.sqrt((half**2).sum(1))[:, None]
            size = norms * (np.sqrt((centres**2).sum(1)) + radii)
            found.append(half @ centres.T + norms * radii + 1e-9 * size + 0.5)
        return found


def _nearest(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = (centres**2).sum(1) - 2 * half @ centres.T
    codes = squares.argmin(1)
    return codes, np.sqrt(((half - centres[codes]) ** 2).sum(1))


def _codebook(half: np.ndarray, count: int) -> np.ndarray:
    """Centres by Lloyd's rounds, from evenly spaced first ones."""
    rows = np.unique(half, axis=0)
    if not len(rows):
        return np.zeros((1, half.shape[1]))
    centres = rows[np.linspace(0, len(rows) - 1, min(count, len(rows))).astype(int)]
    for _ in range(ROUNDS):
        codes, _ = _nearest(half, centres)
        for k in np.unique(codes):
            centres[k] = half[codes == k].mean(0)
    return centres


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as floats; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = np.zeros((len(sizes), width))
    found[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return found


def indexed(rows: DataFrame) -> tuple[DataFrame, _Index]:
    """``rows (vec_id, label, v)`` with their cell and shard, stored, and the index over them."""
    spark = rows.sparkSession
    count, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 0
    share = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(1, count)) * (1 << 20))
    sample = _matrix(rows.where(share).select("v").toArrow().column(0).combine_chunks(), width)
    sample = sample[np.lexsort(sample.T[::-1])] if width and len(sample) else sample
    codes = int(min(CODES, max(4, round(count**0.5 / 8))))
    cut = width // 2
    index = _Index(cut, width, (_codebook(sample[:, :cut], codes), _codebook(sample[:, cut:], codes)))
    sent = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (i, far_i), (j, far_j) = sent.value.codes(_matrix(batch.column("v"), sent.value.width))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x) for x in (i.astype(np.int32), j.astype(np.int32), far_i, far_j))],
                [*batch.schema.names, "i", "j", "far_i", "far_j"],
            )

    coded = rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, v array<long>, i int, j int, far_i double, far_j double")
    parts = max(1, -(-count // SHARD_ROWS))
    dealt = coded.repartitionByRange(parts, "i", "j", F.xxhash64("vec_id")).withColumn("shard", F.spark_partition_id())
    dealt = stored(dealt, "index")
    for n, (code, far) in enumerate((("i", "far_i"), ("j", "far_j"))):
        radii = np.zeros(len(index.centres[n]))
        for row in dealt.groupBy(code).agg(F.max(far).alias("r")).collect():
            radii[row[code]] = row["r"]
        index.radii = (radii,) if n == 0 else (*index.radii, radii)
    cells = sorted(map(tuple, dealt.select("shard", "i", "j").distinct().collect()))
    index.shards = np.array([c[0] for c in cells], np.int64)
    index.cells = np.array([c[1:] for c in cells], np.int64).reshape(-1, 2)
    return dealt.drop("far_i", "far_j"), index


class _Shard:
    """Rows of a shard by cell, and the search over them."""

    def __init__(self, index: _Index, rows: pa.Table):
        order = np.lexsort((rows["j"].to_numpy(), rows["i"].to_numpy()))
        self.ids, self.labels = rows["vec_id"].to_numpy()[order], rows["label"].to_numpy()[order]
        self.vectors = _matrix(rows["v"].combine_chunks(), index.width)[order]
        i, j = rows["i"].to_numpy()[order], rows["j"].to_numpy()[order]
        first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        ends = np.append(first[1:], len(i))
        self.codes = np.unique(i), np.unique(j)
        self.cells = {(int(i[a]), int(j[a])): (int(a), int(b)) for a, b in zip(first, ends, strict=True)}
        self.largest = float(np.sqrt((self.vectors**2).sum(1)).max())

    def visits(self, bounds: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[float, tuple[int, int]]]:
        """Bound and rows of each cell that has any, by falling bound: a heap over both sorted lists."""
        one, two = (codes[np.argsort(-b[codes], kind="stable")].tolist() for codes, b in zip(self.codes, bounds, strict=True))
        up, more = bounds[0][one].tolist(), bounds[1][two].tolist()
        heap = [(-up[0] - more[0], 0, 0)]
        while heap:
            bound, a, b = heapq.heappop(heap)
            if rows := self.cells.get((one[a], two[b])):
                yield -bound, rows
            # (a, b) follows (a, b - 1); the first of a row follows the one above it.
            if b + 1 < len(two):
                heapq.heappush(heap, (-up[a] - more[b + 1], a, b + 1))
            if b == 0 and a + 1 < len(one):
                heapq.heappush(heap, (-up[a + 1] - more[0], a + 1, 0))

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows = self.vectors[at]
        if np.sqrt(query @ query) * self.largest < _EXACT:
            return (rows @ query).astype(np.int64)
        return rows.astype(np.int64) @ query.astype(np.int64)

    def search(
        self, query: np.ndarray, label: int, same: bool, bounds: tuple[np.ndarray, np.ndarray], windows: list[tuple[int, int, int]], count: int
    ) -> tuple[list[tuple[int, int, int]], int]:
        """The first ``count`` rows in each window, and how many rows were scored.

        A window is (smallest score, largest score, what is known to be reached by ``count`` rows).
        """
        scores, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        reach = [max(low, known) for low, _, known in windows]
        visits = self.visits(bounds)
        scored, chunk, more = 0, 256, True
        while more:
            found, size, need = [], 0, min(reach)
            while size < chunk:
                bound, rows = next(visits, (None, None))
                if rows is None or bound < need:
                    more = False
                    break
                found.append(np.arange(*rows))
                size += rows[1] - rows[0]
            if not found:
                break
            at = np.concatenate(found)
            at = at[(self.labels[at] == label) == same]
            scored += len(at)
            fresh = self.scores(query, at)
            fits = np.zeros(len(at), bool)
            for (_, high, _), least in zip(windows, reach, strict=True):
                fits |= (fresh >= least) & (fresh <= high)
            scores, ids = np.concatenate([scores, fresh[fits]]), np.concatenate([ids, self.ids[at[fits]]])
            for n, (_, high, _) in enumerate(windows):
                held = scores[(scores <= high) & (scores >= reach[n])]
                if len(held) >= count:
                    reach[n] = max(reach[n], int(np.partition(held, len(held) - count)[len(held) - count]))
            chunk *= 2
        results = []
        for n, (low, high, _) in enumerate(windows):
            fits = np.flatnonzero((scores >= max(low, reach[n])) & (scores <= high))
            best = fits[np.lexsort((ids[fits], -scores[fits]))][:count]
            results += [(n, int(scores[k]), int(ids[k])) for k in best]
        return results, scored


_QUERY = "qid long, label long, v array<long>, lows array<long>, highs array<long>, reach array<long>"
_SMALLEST = -(1 << 62)


def _routed(queries: DataFrame, index, home: str | None = None) -> DataFrame:
    """``queries`` with a ``shard`` to search.

    That is the one with the highest bound, or, if ``home`` names a column that has this one,
    all others whose bound comes to what the query's windows still ask for.
    """
    columns = [f.strip().split()[0] for f in _QUERY.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: _Index = index.value
        starts = np.flatnonzero(np.concatenate([[True], model.shards[1:] != model.shards[:-1]]))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                one, two = model.bounds(_matrix(part.column("v"), model.width))
                best = np.maximum.reduceat(one[:, model.cells[:, 0]] + two[:, model.cells[:, 1]], starts, axis=1)
                if home is None:
                    row, shard = np.arange(part.num_rows), best.argmax(1)
                else:
                    need = np.array([min(r) for r in part.column("reach").to_pylist()], np.float64)
                    row, shard = np.nonzero((best >= need[:, None]) & (model.shards[starts] != part.column(home).to_numpy()[:, None]))
                taken = part.select(columns).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(model.shards[starts[shard]].astype(np.int32))], [*columns, "shard"])

    return queries.mapInArrow(run, f"{_QUERY}, shard int")


def _searched(rows: DataFrame, queries: DataFrame, index, same: bool, count: int) -> DataFrame:
    """``qid, window, score, vec_id``: what each routed query finds in its shard.

    The rows of a shard come first in its task and are held; queries stream past them.
    """
    nothing = F.lit(None)
    longs = nothing.cast("array<long>")
    both = rows.select(
        "shard", F.lit(0).alias("kind"), "vec_id", "label", "v", "i", "j", longs.alias("lows"), longs.alias("highs"), longs.alias("reach")
    ).unionByName(
        queries.select("shard", F.lit(1).alias("kind"), F.col("qid").alias("vec_id"), "label", "v", nothing.cast("int").alias("i"),
                       nothing.cast("int").alias("j"), "lows", "highs", "reach")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: _Index = index.value
        number, parts, shard = None, [], None
        for batch in batches:
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])]))
            for a, b in zip(edges, [*edges[1:], len(shards)], strict=True):
                part = batch.slice(a, b - a)
                if shards[a] != number:
                    number, parts, shard = shards[a], [], None
                if kinds[a] == 0:
                    parts.append(part)
                    continue
                if shard is None:
                    shard = _Shard(model, pa.Table.from_batches(parts))
                    parts = []
                found = []
                vectors = _matrix(part.column("v"), model.width)
                one, two = model.bounds(vectors)
                labels = part.column("label").to_pylist()
                windows = [list(zip(*w, strict=True)) for w in zip(*(part.column(c).to_pylist() for c in ("lows", "highs", "reach")), strict=True)]
                for k, qid in enumerate(part.column("vec_id").to_pylist()):
                    results, _ = shard.search(vectors[k], labels[k], same, (one[k], two[k]), windows[k], count)
                    found += [(qid, *r) for r in results]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                columns = zip(*found) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["qid", "window", "score", "vec_id"])

    dealt = both.repartition("shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "qid long, window int, score long, vec_id long")


def _best(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("qid", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def search(rows: DataFrame, queries: DataFrame, index, same: bool, count: int) -> DataFrame:
    """``qid, window, score, vec_id, place``: the first ``count`` rows in each window of each query.

    ``queries`` has ``qid, label, v`` and the windows' smallest (``lows``) and largest scores
    (``highs``). With ``same``, rows of the query's label are looked for, else all others.
    """
    start = materialise(_routed(queries.withColumn("reach", F.col("lows")).select("qid", "label", "v", "lows", "highs", "reach"), index), "routed")
    home = materialise(_searched(rows, start, index, same, count), "home")
    # A window with enough rows only takes what reaches the last of them.
    last = home.groupBy("qid", "window").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= count)
    known = last.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("window", "low"))).alias("known"))
    reach = F.transform("lows", lambda low, n: F.greatest(low, F.coalesce(F.try_element_at("known", n), low)))
    again = start.join(known, "qid", "left").withColumn("reach", F.when(F.col("known").isNull(), F.col("lows")).otherwise(reach)).drop("known")
    others = _searched(rows, _routed(again, index, "shard"), index, same, count)
    return stored(_best(home.unionByName(others), count), "found")


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchors: str = "vec_id % 100 = 0",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(256 * x), and a score is the inner product. An anchor's positives are
    its first rows of the same label; for each, the first rows of other labels that score at
    least ``least`` percent of the positive and at most as much. ``anchors`` is a condition on
    ``vec_id``. Higher scores come first, then smaller ids.

    Rows with a null id, label, vector or component, and with one that is not finite, take no
    part; nor do rows with a component of 131,072 or more, whose scores need not fit in 64 bits.
    Components that a shorter vector lacks count as 0. Of rows with one id the first by label,
    then by vector, takes part. Positives with a score below 0 have no negatives. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    given = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{label_col}`").cast("long").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("x"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    given = given.where(F.forall("x", lambda x: F.coalesce(F.abs(x) < _MOST // SCALE, F.lit(False))))
    whole = given.select("vec_id", F.struct("label", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v")).alias("row"))
    rows = materialise(whole.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v"), "rows")

    first = Window.partitionBy("label", "v").orderBy("vec_id")
    kept = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= max(positives, negatives) + 1).drop("n")
    dealt, index = indexed(kept)
    sent = spark.sparkContext.broadcast(index)

    asked = rows.where(anchors)
    queries = materialise(asked.select("label", "v").distinct().withColumn("qid", F.monotonically_increasing_id()), "queries")
    own = materialise(asked.join(queries.select("label", "v", "qid"), ["label", "v"]).select("vec_id", "qid"), "anchors")

    # One more than asked, since the anchor itself may be among them.
    wide = queries.select("qid", "label", "v", F.array(F.lit(_SMALLEST)).alias("lows"), F.array(F.lit(-_SMALLEST)).alias("highs"))
    best = search(dealt, wide, sent, True, positives + 1).select("qid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    others = own.join(best, "qid").where("vec_id <> positive_id")
    place = Window.partitionBy("vec_id", "qid").orderBy(F.desc("positive_score"), "positive_id")
    pairs = materialise(others.withColumn("n", F.row_number().over(place)).where(F.col("n") <= positives).drop("n"), "positives")

    # Windows: one for each score of a positive, all of a query at once.
    scores = pairs.where("positive_score >= 0").groupBy("qid").agg(F.array_sort(F.collect_set("positive_score")).alias("highs"))
    lows = F.expr(f"transform(highs, s -> (s * {int(least)} + 99) div 100)")
    asked = materialise(queries.join(scores, "qid").select("qid", "label", "v", lows.alias("lows"), "highs"), "windows")
    found = search(dealt, asked, sent, False, negatives)
    named = found.join(asked.select("qid", "highs"), "qid").select(
        "qid", F.element_at("highs", F.col("window") + 1).alias("positive_score"), F.col("place").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    return pairs.join(named, ["qid", "positive_score"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


ORACLE = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cell AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS k FROM given),
score AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS s
  FROM cell a JOIN cell b ON a.k = b.k AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
positive AS (SELECT a, b, s FROM score WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
negative AS (
  SELECT p.a, p.b, p.s, n.b AS c, n.s AS t, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS rank
  FROM positive p JOIN score n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND n.s <= p.s)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, c AS negative_id, s AS positive_score, t AS negative_score
FROM negative WHERE rank <= 5"""


@query(ORACLE)
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector, after every seventh label has moved on."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")))
