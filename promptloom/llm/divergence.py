"""How far the sources of a language differ in their words, from in-mapper stripes.

1. Fold. A task folds whole documents into hash stripes: for each (language, term) the number
   of documents, and the number of occurrences by source. When a task holds ``MOST_CELLS``
   counts it spills its stripes as rows and goes on with none, so its memory is bounded and a
   frequent term leaves a task as a few rows, however many documents have it.
2. Merge. Stripes are shuffled once, by (language, term), and added up. Terms in fewer than
   ``least_docs`` documents of their language go; the merged stripes are stored.
3. Emit. One pass over the merged stripes gives the divergences. With p the smoothed share of a
   term in a source, in units of 1e-9, two shares differ by f = (p - q)^2 / (p + q).

   * A source against its language: each task keeps the best terms of each source it has seen.
   * A source against another one: f has to be added over all kept terms, also over those that
     neither source has. So f of two missing counts is taken for every term, and corrected for
     terms that one source has (by how often each count occurs in it) and for terms that both
     have. Work is thus proportional to the counts that are there, not to terms times pairs.

The table of groups, one row per occurring (language, source), is sent to all tasks. The result
has a row for each ordered pair of sources of a language, so the groups are fewer than the rows
of the result (with S sources in a language, S against S * (S - 1)). All arithmetic is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import stored, table
from promptloom.llm.registry import query
from promptloom.session import materialise, ship_package

LEAST_DOCS, TOP_TERMS = 10, 10
MOST_CELLS = 400_000  # counts that a task holds before it spills
_PAIRS = 2_000_000  # pairs of counts that are worked on at once

# ASCII letters in lower case and all bytes of other characters; what else there is separates terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of A-Z, a-z and non-ASCII characters, in order, with A-Z as a-z."""
    return (text or b"").translate(_TERMS).split()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of whole documents: (lang, term, docs, sources, counts)."""
    stripes: dict[str, dict[bytes, dict]] = {}
    names: list[str] = []
    numbers: dict[str, int] = {}
    cells = 0

    def spilled() -> Iterator[pa.RecordBatch]:
        for lang, own in stripes.items():
            rows = list(own.items())
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                docs = [stripe.pop(-1) for _, stripe in part]
                sizes = [len(stripe) for _, stripe in part]
                offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
                sources = pa.array([names[i] for _, stripe in part for i in stripe], pa.string())
                counts = pa.array([n for _, stripe in part for n in stripe.values()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()),
                        pa.array([term for term, _ in part], pa.binary()),
                        pa.array(docs, pa.int64()),
                        pa.ListArray.from_arrays(offsets, sources),
                        pa.ListArray.from_arrays(offsets, counts),
                    ],
                    ["lang", "term", "docs", "sources", "counts"],
                )
        stripes.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = stripes.setdefault(lang, {})
            number = numbers.get(source)
            if number is None:
                number = numbers[source] = len(names)
                names.append(source)
            for term, n in Counter(terms_of(text.as_py())).items():
                stripe = own.get(term)
                if stripe is None:
                    own[term] = {-1: 1, number: n}
                    cells += 1
                else:
                    stripe[-1] += 1
                    if number in stripe:
                        stripe[number] += n
                    else:
                        stripe[number] = n
                        cells += 1
            if cells >= MOST_CELLS:
                yield from spilled()
                cells = 0
    yield from spilled()


def merged_stripes(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, stripe`` of terms in at least ``least_docs`` documents of their language.

    ``docs`` has ``lang``, ``source`` (not null) and ``text`` (binary). A stripe lists the
    sources that have the term, with their counts.
    """
    ship_package(docs.sparkSession)
    rows = docs.select("lang", "source", "text").mapInArrow(
        _folded, "lang string, term binary, docs long, sources array<string>, counts array<long>"
    )
    # Shuffled as stripes; all that follows is done where the stripes of a term have met.
    met = rows.repartition("lang", "term")
    cells = met.select("lang", "term", "docs", F.posexplode(F.arrays_zip("sources", "counts")).alias("at", "cell"))
    counts = cells.groupBy("lang", "term", F.col("cell.sources").alias("source")).agg(
        F.sum("cell.counts").alias("n"), F.sum(F.when(F.col("at") == 0, F.col("docs")).otherwise(0)).alias("docs")
    )
    terms = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("stripe")
    )
    return stored(terms.where(F.col("docs") >= least_docs).select("lang", "term", "stripe"), "stripes")


def _shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (counts + 2) / whole), exactly: three digits at a time, in 64 bits."""
    share, rest = np.divmod(counts + 2, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        share = share * 1000 + digit
    return share + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Groups:
    """The sources of one language: their numbers, totals, and shares of terms they don't have."""

    def __init__(self, sources: list[str], totals: list[int], terms: int):
        self.sources, self.numbers = sources, {s: i for i, s in enumerate(sources)}
        self.whole = np.array(totals, np.int64) + 2 * terms
        self.all_words = np.int64(sum(totals) + 2 * terms)
        self.missing = _shares(np.zeros(len(sources), np.int64), self.whole)


def _emitted(batches: Iterator[pa.RecordBatch], groups: dict[str, _Groups], top: int) -> Iterator[pa.RecordBatch]:
    """From merged stripes: corrections of pairs (source, other, null), and best terms (source, null, term)."""
    best: dict[tuple[str, int], list[tuple[int, bytes]]] = {}
    worst: dict[tuple[str, int], int] = {}  # what a term has to reach once a source has enough of them
    sums: dict[str, dict[int, int]] = {}
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("term", pa.binary()), ("value", pa.int64())])

    def pairs() -> Iterator[pa.RecordBatch]:
        for lang, own in sums.items():
            names, size = groups[lang].sources, len(groups[lang].sources)
            rows = [(lang, names[key // size], names[key % size], None, value) for key, value in own.items()]
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 50_000]), schema, strict=True)], schema=schema)
        sums.clear()

    def add(lang: str, keys: np.ndarray, values: np.ndarray) -> None:
        own = sums.setdefault(lang, {})
        found, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, values)
        for key, value in zip(found.tolist(), total.tolist(), strict=True):
            own[key] = own.get(key, 0) + value

    def work(lang: str, terms: list[bytes], lengths: np.ndarray, number: np.ndarray, counts: np.ndarray) -> None:
        group = groups[lang]
        size = len(group.sources)
        p = _shares(counts, group.whole[number])
        owner = np.repeat(np.arange(len(terms)), lengths)
        together = np.add.reduceat(counts, np.cumsum(lengths) - lengths)
        q = _shares(together, np.full(len(terms), group.all_words))[owner]
        above = np.flatnonzero(p > q)
        values = _distance(p[above], q[above])
        for i, value, term in zip(number[above].tolist(), values.tolist(), owner[above].tolist(), strict=True):
            if -value <= worst.get((lang, i), 0):
                held = best.setdefault((lang, i), [])
                held.append((-value, terms[term]))
                if len(held) >= 4 * top:
                    held.sort()
                    del held[top:]
                    worst[lang, i] = held[-1][0]
        # Terms that one source has: the same for all terms in which it has the same count.
        kinds, times = np.unique(np.stack([number, p]), axis=1, return_counts=True)
        step = max(1, _PAIRS // size)
        for at in range(0, kinds.shape[1], step):
            own, share, n = kinds[0, at : at + step], kinds[1, at : at + step], times[at : at + step]
            more = _distance(share[:, None], group.missing) - _distance(group.missing[own][:, None], group.missing)
            keys = np.minimum(own[:, None], np.arange(size)) * size + np.maximum(own[:, None], np.arange(size))
            apart = own[:, None] != np.arange(size)
            add(lang, keys[apart], (more * n[:, None])[apart])
        # Terms that both sources have: every cell with the later ones of its stripe.
        later = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(number)) - 1
        ends = np.cumsum(later)
        at = 0
        while at < len(number):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
            first = np.repeat(np.arange(at, stop), later[at:stop])
            starts = np.cumsum(later[at:stop]) - later[at:stop]
            second = first + 1 + np.arange(len(first)) - np.repeat(starts, later[at:stop])
            i, j = number[first], number[second]
            none_i, none_j = group.missing[i], group.missing[j]
            change = _distance(p[first], p[second]) - _distance(p[first], none_j) - _distance(none_i, p[second]) + _distance(none_i, none_j)
            add(lang, np.minimum(i, j) * size + np.maximum(i, j), change)
            at = stop

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        stripes = batch.column(2)
        offsets = stripes.offsets.to_numpy()
        cells = stripes.values
        sources, counts = cells.field(0).to_pylist(), cells.field(1).to_numpy()
        terms = batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            rows = np.flatnonzero(langs == lang)
            lengths = (offsets[1:] - offsets[:-1])[rows]
            at = np.repeat(offsets[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            number = np.array([groups[lang].numbers[sources[k]] for k in at], np.int64)
            work(lang, [terms[k] for k in rows], lengths, number, counts[at])
        if sum(map(len, sums.values())) >= MOST_CELLS:
            yield from pairs()
    yield from pairs()
    rows = [(lang, groups[lang].sources[i], None, term, -value) for (lang, i), held in best.items() for value, term in sorted(held)[:top]]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def source_divergences(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every occurring (language, source).

    Part ``pair`` has the divergence from each other source of the language, over all kept
    terms (0 if the language keeps none). Part ``term`` has the ``top`` terms of which the
    source has a larger share than its language. Ranks go by value, largest first, then by the
    item's UTF-8 bytes.

    Null texts, languages and sources are read as ''; such rows form groups like any other.
    A group without terms stands in part ``pair`` only. Repeated rows are separate documents,
    texts of any length are read whole, an empty table gives an empty result, and other columns
    of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    blank = F.lit("")
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), blank).alias("lang"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), blank).alias("source"),
        F.col(f"`{text_col}`").cast("binary").alias("text"),
    )
    stripes = merged_stripes(rows, least_docs)
    words = stripes.select("lang", F.explode("stripe").alias("cell")).groupBy("lang", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("words"))
    terms = stripes.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = materialise(
        rows.select("lang", "source")
        .distinct()
        .join(words, ["lang", "source"], "left")
        .join(terms, "lang", "left")
        .select("lang", "source", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("terms", F.lit(0)).alias("terms")),
        "groups",
    )
    found: dict[str, list] = {}
    for row in groups.orderBy("lang", "source").toLocalIterator():
        found.setdefault(row["lang"], []).append(row)
    sent = spark.sparkContext.broadcast(
        {lang: _Groups([r["source"] for r in own], [r["words"] for r in own], own[0]["terms"]) for lang, own in found.items() if own[0]["terms"]}
    )
    emitted = materialise(
        stripes.mapInArrow(
            lambda batches: _emitted(batches, sent.value, top), "lang string, source string, other string, term binary, value long"
        ),
        "emitted",
    )

    # Each pair in both directions; f of two missing counts stands for every kept term first.
    change = emitted.where("other IS NOT NULL").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    change = change.unionByName(change.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    none = groups.withColumn("p", F.when(F.col("terms") > 0, F.expr("1 + 2000000000L div (words + 2 * terms)")).otherwise(F.lit(1)))
    other = none.select("lang", F.col("source").alias("other"), F.col("p").alias("q"))
    both = none.join(other, "lang").where("source <> other")
    missing = F.expr("terms * (((p - q) * (p - q)) div (p + q))")
    pairs = both.join(change, ["lang", "source", "other"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (missing + F.coalesce("value", F.lit(0))).alias("value")
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = emitted.where("other IS NULL").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    return (
        pairs.withColumn("rank", F.row_number().over(ranked))
        .unionByName(best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))
        .select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
    )


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term FROM word GROUP BY ALL HAVING count(DISTINCT r) >= 10),
cell AS (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN size USING (lang) LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source
  GROUP BY ALL),
share AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + CAST(1000000000 * (coalesce(c.n, 0) + 2) AS HUGEINT) // (g.total + 2 * g.v) AS HUGEINT) AS p
  FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
  SELECT k.lang, k.term, CAST(1 + CAST(1000000000 * (sum(c.n) + 2) AS HUGEINT) // (t.total + 2 * t.v) AS HUGEINT) AS q
  FROM kept k JOIN cell c ON c.lang = k.lang AND c.term = k.term
  JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM grp GROUP BY lang) t ON t.lang = k.lang
  GROUP BY k.lang, k.term, t.total, t.v),
apart AS (
  SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart d ON d.lang = a.lang AND d.source = a.source AND d.other = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT)
  FROM share s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE s.n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C") AS INTEGER) AS rank FROM part)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


@query(ORACLE)
def op11_source_divergence(spark, sf_dir):
    """How each source of each language differs from the others, and its own terms."""
    return source_divergences(table(spark, sf_dir, "documents"))
