"""Mixing sources to target weights by Pareto order sampling.

Every document is expected in the mix as often as its source's target holds the source's
words. The whole part of that number is allocated to each document with certainty. The rest
is an inclusion probability, and the documents of a source are ranked by

    (random odds) / (inclusion odds) = (u / (1 - u)) / (p / (1 - p)).

The first ones in that order are taken once more, as many as bring the words taken nearest
to the target, so a source's sample has a fixed size in words. The random number ``u`` is a
hash of id and text: reruns agree, and no row depends on where it is stored.

Targets: sources weigh 3, 1, 2, 3, 1, 2, … in the order of their code points, null last, and
share ``share`` times all words. A target ends at ``most`` times the words of its source; what
is above is shared by weight among the others. The level at which that comes to rest follows
from running sums over the sources by (largest target / weight).

Nothing here is larger than one row per source but the documents themselves. A source with a
third of all rows is ranked over many partitions (``prefix.running_totals``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import NOT_SPACE, table
from promptloom.llm.registry import query
from promptloom.operators.prefix import number_rows, running_totals
from promptloom.session import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2


def _hash_number(*parts: Column) -> Column:
    """A number in (0, 1) from a digest of the parts."""
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, u`` of each row: its words and its random number.

    A null or empty text has size 0. Rows that agree in id and text share their number.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(NOT_SPACE)).cast("bigint").alias("size"),
        _hash_number(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)).alias("u"),
    )


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES
) -> DataFrame:
    """``source, source_size, target`` with one row per source (null is a source of its own).

    A source without words gets the target 0. No rows give no sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = F.lit(1).alias("every")
    ranked = number_rows(totals.select("*", every, F.col("source").isNull().alias("no_source")), ["every"], ["no_source", "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = materialise(
        ranked.select("source", "source_size", "every", "rank", weight.cast("bigint").alias("weight"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("level", F.col("cap").cast("double") / F.col("weight")),
        "sources",
    )
    running = running_totals(sources, ["every"], ["level", "rank"], {"caps": "cap", "weights": "weight"})
    whole = sources.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weights"))
    # If all before this one stop at their largest target, the others get this much per weight.
    left = F.lit(share) * F.col("all_words").cast("double") - (F.col("caps") - F.col("cap")).cast("double")
    level = left / (F.col("all_weights") - F.col("weights") + F.col("weight")).cast("double")
    fits = materialise(running.crossJoin(F.broadcast(whole)).select("*", level.alias("fill")), "levels")
    rest = fits.where("fill <= level").agg(F.min_by("fill", F.struct("level", "rank")).alias("rest"))
    return fits.crossJoin(F.broadcast(rest)).select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("rest") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
    )


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies``: one row per row of ``docs``.

    ``copies`` says how often the document stands in the mix, ``taken`` the words that makes.
    Rows with size 0 take no words; they get the whole copies only. Null ids are ids like any
    other; repeated rows are separate rows, and it does not matter which of them is taken. An
    empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    sized = materialise(sized_documents(docs, id_col, text_col, source_col), "sized")
    targets = materialise(source_targets(sized, weights, share, most), "targets")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = (
        sized.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
        .drop("t_source")
        .withColumn("whole", F.floor(expected))
        .withColumn("p", expected - F.floor(expected))
        .withColumn("no_source", F.col("source").isNull())
    )
    odds = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    ranked = running_totals(
        joined.withColumn("odds", odds), ["no_source", "source"], ["odds", "doc_id", "size"], {"reached": "size"}
    )
    # Taken once more while that brings the source's words nearer to its target.
    open_words = F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")
    nearer = (F.col("reached") - F.col("size") / F.lit(2.0)) <= open_words
    copies = F.col("whole") + F.when((F.col("p") > 0) & (F.col("size") > 0) & nearer, 1).otherwise(0)
    return ranked.withColumn("copies", copies.cast("bigint")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


@query(
    r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 12)
           AS UBIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size, 2 * sum(size) AS cap,
         row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sources),
levelled AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS level FROM weighed),
running AS (
  SELECT *, sum(cap) OVER w - cap AS caps_before, sum(weight) OVER w - weight AS weights_before
  FROM levelled WINDOW w AS (ORDER BY level, rank)),
filled AS (
  SELECT *, (1.5 * CAST((SELECT sum(source_size) FROM sources) AS DOUBLE) - CAST(caps_before AS DOUBLE))
         / CAST((SELECT sum(weight) FROM weighed) - weights_before AS DOUBLE) AS fill FROM running),
rest AS (SELECT fill AS rest FROM filled WHERE fill <= level ORDER BY level, rank LIMIT 1),
targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         least(CAST(cap AS DOUBLE), coalesce((SELECT rest FROM rest) * weight, CAST(cap AS DOUBLE))) AS target
  FROM filled),
joined AS (
  SELECT s.doc_id, s.source, s.size, s.u, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS expected
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, expected - floor(expected) AS p,
         (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) AS odds FROM joined),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS UNBOUNDED PRECEDING) AS reached FROM ranked)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(expected) + CASE WHEN p > 0 AND size > 0
         AND reached - size / 2.0 <= target - floor(expected) * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed"""
)
def op9_mix_sources(spark, sf_dir):
    """Words each document gives to the mix of all sources."""
    return mix_documents(table(spark, sf_dir, "documents")).drop("copies")
