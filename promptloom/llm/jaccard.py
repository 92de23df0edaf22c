"""Joining documents whose sets of word n-grams have a high Jaccard similarity.

The similarities are entries of the product of the document by n-gram incidence matrix with
its transpose. Only entries that can reach the threshold are computed:

1. A set of size s can only agree with another one if both hold one of each other's first
   ``s - ceil(t s) + 1`` n-grams in a common order. These columns of the matrix are the
   candidates' postings. The order puts n-grams that very many documents hold last.
2. Rows with equal sets are one row of the matrix.
3. Each row is multiplied with the smallest row that shares a posting with it, in blocks of
   columns: a sixteenth of them, an eighth, then the rest. The overlap of a pair is accumulated
   block by block, and a pair is discarded as soon as the columns that are left to its smaller
   side can't make up what it still needs. Pairs carry a block at a time. Only those that pass
   three sixteenths of the columns are multiplied over whole texts.
4. What that links is merged to components. Postings whose rows now lie in one component
   are done. In the others, the rows of other components than the posting's smallest row are
   multiplied with that one, and then the pairs that still lie in different components. There,
   postings are split into bands of sizes, and a row meets only its own band and the next ones.
   A row's place in the order bounds how large a partner with the same first common column may
   be. Among rows that would meet more rows than they have columns, the columns that no such row
   of another component holds add nothing to an overlap, so the others bound the size of a
   partner too; rows without a possible partner leave the posting.

So no link between different components is lost, and large groups of copies cost one
comparison per row. Links inside a component are not listed one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm.common import add_columns, runs_of_words, stored, table, word_hashes
from promptloom.llm.components import components
from promptloom.llm.registry import query
from promptloom.session import drop_table

PERCENT, WIDTH = 85, 4
# An n-gram of more than 1/FREQUENT of all documents comes last in the order. There are at
# most FREQUENT times the mean set size of them, and the order decides costs only.
FREQUENT, FREQUENT_LEAST, FREQUENT_MOST = 2000, 50, 500_000

# Rows that would meet more rows than this, and than they have n-grams, are thinned by the bound
# on partners before they meet. It decides costs only.
CROWD = 50

# Sets of recent rows that a task keeps while it counts overlaps, in n-grams of 8 bytes.
KEPT_GRAMS = 2_000_000

# The first blocks of columns: n-grams whose hash is in these ranges.
_BLOCKS = ((15 << 60, (1 << 64) - 1), (13 << 60, (15 << 60) - 1))


def _gram_set(text: bytes | None, width: int) -> np.ndarray:
    words = word_hashes(text.lower() if text else b"")
    return np.unique(runs_of_words(words, min(width, max(len(words), 1))))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _often(sets: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that at least ``least`` of the ``sets`` hold, sorted, and how many do. Empties the list."""
    grams = np.concatenate(sets or [np.empty(0, np.uint64)])
    sets.clear()
    grams.sort()
    ahead = grams[least - 1 :]
    found = np.unique(ahead[ahead == grams[: len(ahead)]])
    return found, np.searchsorted(grams, found, "right") - np.searchsorted(grams, found)


def _frequent_in_batches(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_gram_set(x.as_py(), width) for x in batch.column(0)]
            grams, counts = _often(sets, max(5, batch.num_rows // FREQUENT))
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], ["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long")


def frequent_grams(texts: DataFrame, width: int, rows: int) -> np.ndarray:
    """Sorted hashes of n-grams that stand in very many documents; at most FREQUENT_MOST."""
    totals = _frequent_in_batches(texts, width).groupBy("gram").agg(F.sum("n").alias("n"))
    many = totals.where(F.col("n") >= max(FREQUENT_LEAST, rows // FREQUENT))
    found = many.orderBy(F.desc("n"), "gram").limit(FREQUENT_MOST).select("gram").toArrow().column(0)
    return np.sort(found.to_numpy().view(np.uint64))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``id, size, set_key`` and the first blocks of each row. The key is null for an empty set."""
    fields = T.StructType(
        [
            T.StructField("size", T.LongType(), False),
            T.StructField("set_key", T.BinaryType()),
            *[T.StructField(f"block_{n}", T.BinaryType()) for n in range(len(_BLOCKS))],
        ]
    )

    def make():

        def step(batch: pa.RecordBatch) -> list:
            sets = [_gram_set(x.as_py(), width) for x in batch.column(0)]
            keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            blocks = [
                [x[np.searchsorted(x, np.uint64(low)) : np.searchsorted(x, np.uint64(high), "right")].tobytes() for x in sets]
                for low, high in _BLOCKS
            ]
            return [[len(x) for x in sets], keys, *blocks]

        return step

    return add_columns(texts, ["text"], fields, make, ["id"])


def _largest(overlap, size, percent: int):
    """The size of the largest partner of a set of ``size`` that an overlap of ``overlap`` suffices for."""
    return overlap * (100 + percent) // percent - size


def _postings(texts: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """``gram, id, size, largest``: one row per n-gram of a prefix.

    Two rows whose first common n-gram in the order is ``gram`` overlap in it and later ones only,
    so there no partner is larger than ``largest``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                prefixes, sizes = [], []
                for text in part.column(1):
                    grams = _gram_set(text.as_py(), width)
                    length = len(grams) - -(-len(grams) * percent // 100) + 1 if len(grams) else 0
                    late = np.isin(grams, often, assume_unique=True)
                    rare = grams[~late][:length]
                    prefixes.append(np.concatenate([rare, grams[late][: length - len(rare)]]))
                    sizes.append(len(grams))
                counts = np.array([len(x) for x in prefixes], np.int64)
                size = np.repeat(np.array(sizes, np.int64), counts)
                place = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(prefixes).view(np.int64)),
                        pa.array(np.repeat(part.column(0).to_numpy(), counts)),
                        pa.array(size),
                        pa.array(_largest(size - place, size, percent)),
                    ],
                    ["gram", "id", "size", "largest"],
                )

    return texts.mapInArrow(run, "gram long, id long, size long, largest long")


def _may_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct ``pairs (a, b)`` that sizes and the first blocks of columns leave over.

    ``need`` is the overlap that a pair lacks for a link, ``left_a`` and ``left_b`` how many
    n-grams of its rows are in blocks to come.
    """
    open_pairs = F.col("need") <= F.least("left_a", "left_b")
    state = pairs
    for number in range(len(_BLOCKS)):
        # Sizes come with the first block, from the same rows of the table.
        for x in "ab":
            own = [F.col("id").alias(x), F.col(f"block_{number}").alias(f"block_{x}")]
            state = state.join(sets.select(*own, *[F.col("size").alias(f"left_{x}")] * (number == 0)), x)
        if number == 0:
            both = F.col("left_a") + F.col("left_b")
            state = state.withColumn("need", F.ceil(percent * both / F.lit(100 + percent)).cast("long")).where(open_pairs)
        state = state.select("a", "b", "need", "left_a", "left_b", "block_a", "block_b")
        counted = state.mapInArrow(_add_block, "a long, b long, need long, left_a long, left_b long")
        state = stored(counted.where(open_pairs).distinct(), "pairs")
    return state.select("a", "b").distinct()


def _add_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Accumulate the overlap in one block of columns."""
    for batch in batches:
        need, left_a, left_b = (batch.column(i).to_numpy().copy() for i in (2, 3, 4))
        for i, (a, b) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)):
            block_a, block_b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            need[i] -= _overlap(block_a, block_b)
            left_a[i] -= len(block_a)
            left_b[i] -= len(block_b)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(need), pa.array(left_a), pa.array(left_b)],
            ["a", "b", "need", "left_a", "left_b"],
        )


def _overlap(one: np.ndarray, other: np.ndarray) -> int:
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    if not len(small):
        return 0
    return int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))


def _outer_grams(rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``row, outer``: how many n-grams of a row a row of another label in ``rows (row, label)`` holds too.

    The other columns add nothing to an overlap of rows with different labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [_gram_set(x and packer.decompress(x), width) for x in part.column(2).to_pylist()]
                counts = [len(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(sets).view(np.int64)),
                        *(pa.array(np.repeat(part.column(k).to_numpy(), counts)) for k in (0, 1)),
                    ],
                    ["gram", "row", "label"],
                )

    named = rows.join(texts.withColumnRenamed("id", "row"), "row").select("row", "label", "text")
    grams = named.mapInArrow(run, "gram long, row long, label long")
    mixed = grams.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return grams.join(mixed.select("gram"), "gram").groupBy("row").agg(F.count("*").alias("outer"))


_NEAR = "explode(sequence(band - 1, band + 1)) AS band"


def _crowded(open_rows: DataFrame) -> DataFrame:
    """``row, label`` of the rows that would meet more rows than they have n-grams, and more than ``CROWD``."""
    counts = open_rows.groupBy("gram", "band").agg(F.count("*").alias("n"))
    around = counts.selectExpr("gram", _NEAR, "n").groupBy("gram", "band").agg(F.sum("n").alias("n"))
    met = open_rows.join(around, ["gram", "band"]).groupBy("row", "label").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    return met.where(F.col("n") > F.greatest(F.col("size"), F.lit(CROWD))).select("row", "label")


def _meeting(rows: DataFrame, others: DataFrame) -> DataFrame:
    """``a, b``: pairs of a row and another one of a posting whose labels differ and whose sizes may link."""
    names = [f"{name} AS o_{name}" for name in ("row", "label", "size", "largest")]
    other = others.selectExpr("gram", *names, _NEAR)
    may = "row <> o_row AND label <> o_label AND size <= o_largest AND o_size <= largest"
    return rows.join(other, ["gram", "band"]).where(may).select(F.least("row", "o_row").alias("a"), F.greatest("row", "o_row").alias("b"))


def _across(open_rows: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """``a, b``: the pairs of rows with different labels that ``open_rows`` leaves to be compared.

    Two crowded rows overlap by no more than the outer n-grams of either; others meet every row.
    """
    crowded = stored(_crowded(open_rows), "crowded")
    few = open_rows.join(crowded.select("row"), "row", "left_anti")
    outer = _outer_grams(crowded, texts, width)
    bound = F.floor(F.col("outer") * (100 + percent) / F.lit(percent)).cast("long") - F.col("size")
    bounded = open_rows.join(outer, "row").withColumn("largest", F.least("largest", bound))
    many = stored(bounded.where(100 * F.col("largest") >= percent * F.col("size")).select(*open_rows.columns), "bounded")
    return _meeting(few, open_rows).unionByName(_meeting(many, many)).distinct()


def _packed(texts: DataFrame) -> DataFrame:
    """``id, text`` with compressed texts, stored: pairs carry them through shuffles."""

    def make():
        packer = zstandard.ZstdCompressor(level=3)
        return lambda batch: [[None if x.as_py() is None else packer.compress(x.as_py()) for x in batch.column(0)]]

    fields = T.StructType([T.StructField("text", T.BinaryType())])
    return stored(add_columns(texts.where("id IS NOT NULL"), ["text"], fields, make, ["id"]), "texts")


def _links(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The ``pairs (a, b)`` whose overlap over all columns reaches the threshold."""
    first, second = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, known, held = zstandard.ZstdDecompressor(), {}, 0

        def grams(packed: bytes | None) -> np.ndarray:
            nonlocal held
            if packed not in known:
                row = _gram_set(packed and packer.decompress(packed), width)
                if held + len(row) > KEPT_GRAMS:
                    known.clear()
                    held = 0
                known[packed] = row
                held += len(row)
            return known[packed]

        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                row, other = grams(a.as_py()), grams(b.as_py())
                overlap = _overlap(row, other)
                keep.append(overlap * 100 >= percent * (len(row) + len(other) - overlap))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return stored(both.mapInArrow(run, "a long, b long"), "links")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs``.

    Texts are folded to lower case (A-Z) and split at white space. A text of fewer words than
    ``width`` has its whole word sequence as its only n-gram; a null, empty or blank text has
    none and links with nothing. Documents link if 100 times the size of the intersection is
    at least ``percent`` times that of the union. ``component_id`` is the smallest id that
    links reach. Rows with equal ids are one document with several texts, which links where
    any of them does. A row with a null id links with nothing and has a null component.
    An empty table gives an empty result; other columns are ignored. Ids are integers.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    frequent = context.broadcast(frequent_grams(texts.select("text"), width, docs.count()))
    sets = stored(_sets(texts, width), "sets")
    named = sets.where("id IS NOT NULL AND set_key IS NOT NULL")
    first = named.groupBy("set_key").agg(F.min("id").alias("row"))
    copies = stored(named.select("id", "set_key").join(first, "set_key").where("id <> row").select("id", "row"), "copies")

    # Read twice below; making them takes longer than writing them.
    postings = stored(_postings(texts.where("id IS NOT NULL"), width, percent, frequent), "postings")
    ends = postings.groupBy("gram").agg(F.min("id").alias("a"), F.count("*").alias("n"))
    shared = postings.join(ends.where("n > 1").select("gram", "a"), "gram")
    rows = shared.join(copies.distinct(), "id", "left").select("gram", "a", F.coalesce("row", "id").alias("row"), "size", "largest")
    shared = stored(rows.distinct(), "shared")
    drop_table(postings)
    stars = shared.where("row <> a").select("a", F.col("row").alias("b"))

    packed = _packed(texts)

    def linked(pairs: DataFrame) -> DataFrame:
        return _links(_may_link(pairs, sets, percent), packed, percent, width)

    def labels_of(roots: DataFrame, rows: DataFrame, row: str, label: str) -> DataFrame:
        known = roots.select(F.col("node").alias(row), F.col("root").alias("known"))
        return rows.join(known, row, "left").withColumn(label, F.coalesce("known", row)).drop("known")

    done = stored(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    roots = components(linked(done))

    both = labels_of(roots, labels_of(roots, stars.distinct(), "a", "label_a"), "b", "label_b")
    apart = both.where("label_a <> label_b").select("a", "b").join(done, ["a", "b"], "left_anti")
    apart = stored(apart, "pairs")
    # The links to roots join what the links did, with fewer rounds to go.
    roots = components(roots.toDF("a", "b").unionByName(linked(apart)))
    done = done.unionByName(apart)

    labelled = labels_of(roots, shared.select("gram", "row", "size", "largest"), "row", "label")
    ends = labelled.groupBy("gram").agg(F.min("label").alias("first"), F.max("label").alias("last"))
    # Sizes of a link differ by a factor of 100 / percent at most; a band is a little wider than that.
    band = F.floor(F.log("size") / (math.log(100 / percent) + 1e-6)).cast("long")
    mixed = labelled.join(ends.where("first < last").select("gram"), "gram")
    open_rows = stored(mixed.where(100 * F.col("largest") >= percent * F.col("size")).withColumn("band", band), "open")
    across = _across(open_rows, packed, percent, width)
    more = linked(stored(across.join(done, ["a", "b"], "left_anti"), "across"))

    same = copies.select(F.col("id").alias("a"), F.col("row").alias("b"))
    roots = components(roots.toDF("a", "b").unionByName(more).unionByName(same))
    return sets.join(roots, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("root", "id").alias("component_id")
    )


ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
overlap AS (
  SELECT x.r AS a, y.r AS b, count(*) AS k FROM gram x JOIN gram y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
link AS (
  SELECT a, b FROM overlap JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (
  SELECT r AS a, r AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT x.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(y.doc_id) AS component_id
FROM reach JOIN doc x ON x.r = reach.a JOIN doc y ON y.r = reach.b LEFT JOIN size ON size.r = reach.a
GROUP BY reach.a, x.doc_id"""


@query(ORACLE)
def op7_jaccard_join(spark, sf_dir):
    """Component of every document under shingle similarity."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component.

    All rows with such an id stay, and so do rows without words, which link with nothing, and
    rows with a null id. The columns are those of ``docs``.
    """
    gone = jaccard_components(docs, id_col, text_col, percent, width).where("doc_id <> component_id")
    ids = gone.select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(ids, docs[id_col] == F.col("__gone_id"), "left_anti")
