"""Line dedup with a suffix array over line ids, built by distributed prefix doubling.

All documents, in the order of their ids, form one sequence of lines. The suffixes of that
sequence are ranked by their first line, then by their first 2, 4, 8, … lines: the rank for
twice the depth follows from the pair (own rank, rank of the suffix ``depth`` lines on). A
suffix leaves as soon as no other one agrees with it or its document ends, and lines that
stand only once never enter. Suffixes of equal rank at depth d are a longest-common-prefix
interval: the d lines they start with stand at each of their places, and all places but the
first are later copies.

The largest depth at which a place is a later copy, for every place, covers exactly the
maximal repeated runs: a run of L lines is covered by the copies of depth 2^k <= L at its
start and at its end. Copies that share a line form one run. Runs of at least ``min_words``
words are deleted wherever they are later copies.

Every step is a join or an aggregation over (place, rank). Ranks grow in the order of the
groups, which are range-sorted, and may have gaps, so nothing has to be counted across partitions.
A line that a third of all documents hold is one group of many rows,
which is counted on the map side and whose join Spark splits. Levels are written to the
shared folder. Pairs of ranks are written too, as they are read twice: jobs, stages and tasks
cost the driver memory, however few rows they have.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm.common import NOT_SPACE, add_columns, table
from promptloom.llm.registry import query
from promptloom.operators.prefix import number_rows
from promptloom.session import drop_table, materialise

MIN_WORDS = 5
_LOWEST = -(1 << 63)


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Order of the documents; rows that agree in both are one document."""
    return [
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LOWEST)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"),
    ]


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, tag, line, id, words``: the lines of each document, counted from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(*_keys(id_col, text_col), F.posexplode(F.split(text, "\n")).alias("line", "value"))
    bare = F.regexp_replace("value", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return lines.select(
        "doc", "tag", "line", F.unhex(F.md5(bare)).alias("id"), F.regexp_count("value", F.lit(NOT_SPACE)).alias("words")
    ).distinct()


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``at, end, rank, first`` of the stored ``rows`` whose ``keys`` occur more than once.

    Equal keys have equal ranks, and ranks grow with the keys.
    """
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1").drop("n")
    in_order = groups.repartitionByRange(*[F.col(key) for key in keys]).sortWithinPartitions(*keys)
    ranks = materialise(in_order.withColumn("rank", F.monotonically_increasing_id()), "order")
    ranked = materialise(rows.join(ranks, keys).select("at", "end", "rank", "first"), "ranks")
    drop_table(ranks)
    return ranked


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, tag, line, words, run``: lines that lie in a later copy of a repeated run.

    ``run`` is the first line of the maximal run, counted from 0 within the document.
    """
    lines = materialise(line_table(docs, id_col, text_col), "lines")
    often = lines.groupBy("id").count().where("count > 1").select("id")
    # Places of repeated lines in reading order; neighbours in a document are neighbours here.
    order = ["doc", "tag", "line"]
    numbered = number_rows(lines.join(often, "id").withColumn("every", F.lit(1)), ["every"], order, "at").drop("every")
    stretch = Window.partitionBy("doc", "tag", F.col("at") - F.col("line"))
    places = materialise(numbered.withColumn("end", F.max("at").over(stretch) + 1), "places")

    depth, level = 1, _ranked(places.select("at", "end", "id"), ["id"])
    copies = level.where("first < at").select("at", F.lit(1).cast("bigint").alias("length"))
    while True:
        ahead = level.select((F.col("at") - depth).alias("at"), F.col("rank").alias("next"))
        pairs = level.join(ahead, "at").where(F.col("at") + 2 * depth <= F.col("end"))
        pairs = materialise(pairs.select("at", "end", F.col("rank").alias("before"), "next"), "pairs")
        depth, level = 2 * depth, _ranked(pairs, ["before", "next"])
        drop_table(pairs)
        if level.isEmpty():
            break
        copies = copies.unionByName(level.where("first < at").select("at", F.lit(depth).cast("bigint").alias("length")))

    longest = copies.groupBy("at").agg(F.max("length").alias("length"))
    in_order = Window.partitionBy("doc", "tag").orderBy("at")
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.col("at") + F.col("length")
    return (
        places.join(longest, "at", "left")
        .withColumn("reach", F.max(reach).over(upto))
        .withColumn("reached", F.max(reach).over(before))
        .where("reach > at")
        .withColumn("run", F.max(F.when(F.coalesce(F.col("reached") <= F.col("at"), F.lit(True)), F.col("line"))).over(upto))
        .select("doc", "tag", "line", "words", "run")
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with ``n_lines`` and ``n_removed``, and repeated lines deleted from the text.

    Lines end at a line feed and are compared without white space at their ends; they stay as
    they are. Documents are ordered by id, null first, then by a hash of the text. Rows that
    agree in id and text are one document: they are treated alike and do not delete each
    other. A null text stays null and has no lines; an empty one has one empty line, which is
    never deleted. Columns of ``docs`` with the new names are replaced; others stay.
    """
    runs = repeated_runs(docs, id_col, text_col)
    whole = Window.partitionBy("doc", "tag", "run")
    gone = (
        runs.withColumn("all_words", F.sum("words").over(whole))
        .where(F.col("all_words") >= min_words)
        .groupBy(F.col("doc").alias("__dup_doc"), F.col("tag").alias("__dup_tag"))
        .agg(F.collect_set("line").alias("__dup_gone"))
    )
    doc, tag = _keys(id_col, text_col)
    joined = docs.join(gone, (doc == F.col("__dup_doc")) & (tag == F.col("__dup_tag")), "left")
    fields = T.StructType(
        [
            T.StructField(text_col, T.StringType()),
            T.StructField("n_lines", T.LongType(), False),
            T.StructField("n_removed", T.LongType(), False),
        ]
    )

    def make():
        def step(batch: pa.RecordBatch) -> list:
            texts, counts, removed = [], [], []
            for text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                drop = set(gone or ())
                texts.append(text if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop))
                counts.append(len(lines))
                removed.append(len(drop))
            return [texts, counts, removed]

        return step

    done = add_columns(joined, [text_col, "__dup_gone"], fields, make, docs.columns)
    rest = [name for name in docs.columns if name not in ("n_lines", "n_removed")]
    return done.select(*[f"`{name}`" for name in rest], "n_lines", "n_removed")


@query()
def op2_line_dedup(spark, sf_dir):
    """Lines left in every document once later copies of repeated runs are deleted."""
    done = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later copies of runs; rows of which no word is left by that are dropped."""
    fresh = {name: f"__dup_own_{name}" for name in ("n_lines", "n_removed") if name in docs.columns}
    done = drop_repeated_lines(docs.withColumnsRenamed(fresh), id_col, text_col)
    kept = done.where((F.col("n_removed") == 0) | F.col(text_col).rlike(NOT_SPACE)).drop("n_lines", "n_removed")
    return kept.withColumnsRenamed({new: old for old, new in fresh.items()}).select(*[f"`{c}`" for c in docs.columns])
