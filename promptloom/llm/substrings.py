"""Substring dedup: suffix automata of reference passages, and documents streamed through them.

A document's words are deleted where a window of ``WINDOW`` words also starts in a document
with a smaller id. All documents are reference and query at once, so the reference is divided
into shards and every query goes to the shard that can hold it:

1. Each window names one of its ``k``-word runs, the one with the smallest hash. Equal windows
   name equal runs. Runs of one document only lead nowhere; a run of several documents leads
   to the first of them, and that document's windows with such runs are the shard.
2. A task builds the suffix automaton of a shard's passages and streams the query passages
   through it. The matching statistic, the longest suffix read so far that stands in the
   shard, is at least ``WINDOW`` exactly at the ends of repeated windows.
3. Windows that share a run with the first document but are not in it go through the same
   steps once more, named by the whole window.

Rows that are moved are run hashes with ids, and passages with repeated runs. A shard with
very many queries is copied to several tasks, each with a part of them; a task holds the
automaton of one document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm.common import add_columns, runs_of_words, stored, table, word_hashes
from promptloom.llm.registry import query

WINDOW, RUN = 13, 5
QUERIES_PER_TASK = 1000  # passages that one copy of a shard answers

_ROUTED = "route long, id long, tag long, start long, words binary"
_FOUND = "id long, tag long, start long, stop long, words binary"


class SuffixAutomaton:
    """Accepts every run of words of the passages that were added."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, moves: dict[bytes, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A state for the part of ``target`` that is reached from ``state`` directly."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(dict(self.next[target]), self.link[target], self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            target = self.next[last].get(word)
            if target is not None:
                last = self._split(last, word, target)
                continue
            fresh, state = self._state({}, 0, self.length[last] + 1), last
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = fresh
                state = self.link[state]
            if state >= 0:
                self.link[fresh] = self._split(state, word, self.next[state][word])
            last = fresh

    def statistics(self, words: list[bytes]) -> Iterator[int]:
        """For each place the length of the longest run ending there that was added."""
        state = matched = 0
        moves, link, length = self.next, self.link, self.length
        for word in words:
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            target = moves[state].get(word)
            if target is not None:
                state, matched = target, matched + 1
            yield matched


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    count, reach = len(values) - width + 1, 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:count], values[width - reach : width - reach + count])


def _named_runs(text: bytes | None, window: int, run: int) -> np.ndarray:
    """For each window of words of ``text`` the hash of the run that it names."""
    words = word_hashes(text)
    if len(words) < window:
        return np.empty(0, np.int64)
    runs = runs_of_words(words, run)
    if run < window:
        # Runs only lead to shards, and five bytes tell them apart well enough.
        runs = _least(runs >> np.uint64(24), window - run + 1)
    return runs.view(np.int64)


def _runs(passages: DataFrame, window: int, run: int) -> DataFrame:
    """``run, id`` of all windows; neighbours that name the same run give one row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                named = []
                for text in part.column(1):
                    own = _named_runs(text.as_py(), window, run)
                    named.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
                ids = np.repeat(part.column(0).to_numpy(), [len(x) for x in named])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(named)), pa.array(ids)], ["run", "id"])

    return passages.select("id", "words").mapInArrow(work, "run long, id long")


def _routed(passages: DataFrame, window: int, run: int) -> DataFrame:
    """Parts of the passages whose windows name repeated runs, with the document they lead to."""
    runs = stored(_runs(passages, window, run), "runs")  # read twice below
    ends = runs.groupBy("run").agg(F.min("id").alias("route"), F.max("id").alias("last")).where("route < last")
    led = runs.join(ends.select("run", "route"), "run").groupBy("id").agg(
        F.collect_list("run").alias("runs"), F.collect_list("route").alias("routes")
    )
    led = stored(led, "led")  # the shuffles of runs go before texts are shuffled
    rows = passages.join(led, "id").select("id", "tag", "start", "words", "runs", "routes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[tuple] = []
                for i in range(part.num_rows):
                    number, tag, start, text = (part.column(c)[i].as_py() for c in range(4))
                    words = text.split()
                    named = _named_runs(text, window, run)
                    own, routes = (np.asarray(part.column(c)[i].values, np.int64) for c in (4, 5))
                    order = np.argsort(own)
                    own, routes = own[order], routes[order]
                    spot = np.minimum(np.searchsorted(own, named), len(own) - 1)
                    leads = own[spot] == named
                    to = np.where(leads, routes[spot], -1)
                    breaks = np.flatnonzero((np.diff(to) != 0) | (np.diff(leads.astype(np.int8)) != 0)) + 1
                    for first, stop in zip([0, *breaks], [*breaks, len(named)], strict=True):
                        if first < stop and leads[first]:
                            out.append((int(to[first]), number, tag, start + int(first), b" ".join(words[first : stop + window - 1])))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("route", "id", "tag", "start", "words"), x, strict=True)) for x in out], _ROUTED_ARROW
                )

    return stored(rows.mapInArrow(work, _ROUTED), "routed")


_ROUTED_ARROW = pa.schema([("route", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("words", pa.binary())])
_FOUND_ARROW = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("words", pa.binary())])


def _ranges(automaton: SuffixAutomaton, words: list[bytes], window: int) -> Iterator[tuple[int, int, bytes | None]]:
    """Ranges of words that windows in the shard cover, and with their words those of the others."""
    length = np.fromiter(automaton.statistics(words), np.int64, len(words))
    hit = length[window - 1 :] >= window
    breaks = np.flatnonzero(hit[1:] != hit[:-1]) + 1
    for first, stop in zip([0, *breaks.tolist()], [*breaks.tolist(), len(hit)], strict=True):
        yield first, stop + window - 1, None if hit[first] else b" ".join(words[first : stop + window - 1])


def _streamed(routed: DataFrame, window: int) -> DataFrame:
    """Matched ranges of words (``words`` is null) and the passages of other windows."""
    queries, shards = routed.where("id <> route"), routed.where("id = route")
    many = queries.groupBy("route").count().where(F.col("count") > QUERIES_PER_TASK)
    fans = many.select("route", F.ceil(F.col("count") / QUERIES_PER_TASK).cast("long").alias("fan"))
    dealt = queries.join(fans, "route", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("id", "start"), F.col("fan")), F.lit(0))
    )
    copied = shards.join(fans, "route", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("fan", F.lit(1).cast("long")) - 1))
    )
    both = copied.withColumn("role", F.lit(0)).unionByName(dealt.withColumn("role", F.lit(1)))
    ordered = both.repartition("route", "part").sortWithinPartitions("route", "part", "role")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, SuffixAutomaton()
        known: dict[bytes, list[tuple[int, int, bytes | None]]] = {}  # copies get the same answer
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[tuple] = []
                columns = [part.column(c).to_pylist() for c in range(7)]
                for route, copy, role, number, tag, start, text in zip(*columns, strict=True):
                    if role == 0:
                        if shard != (route, copy):
                            shard, automaton = (route, copy), SuffixAutomaton()
                            known.clear()
                        automaton.add(text.split())
                        continue
                    if text not in known:
                        if len(known) >= 1000:
                            known.clear()
                        known[text] = list(_ranges(automaton, text.split(), window))
                    out += [(number, tag, start + first, start + stop, rest) for first, stop, rest in known[text]]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(_FOUND_ARROW.names, x, strict=True)) for x in out], _FOUND_ARROW
                )

    columns = ["route", "part", "role", "id", "tag", "start", "words"]
    return stored(ordered.select(*columns).mapInArrow(work, _FOUND), "streamed")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """``id, tag, start, stop``: ranges of words covered by windows of earlier documents.

    ``tag`` is a hash of the text, for rows that share an id. Ranges may overlap.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    passages = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), F.lit(0).cast("long").alias("start"), text.cast("binary").alias("words")
    )
    first = _streamed(_routed(passages, window, min(run, window)), window)
    rest = first.where("words IS NOT NULL").select("id", "tag", "start", "words")
    second = _streamed(_routed(rest, window, window), window)
    return first.unionByName(second).where("words IS NULL").select("id", "tag", "start", "stop")


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``, the kept words joined by a blank.

    Words are what stands between white space. A null or empty text has none. Documents with
    fewer words than a window lose nothing. Rows with equal ids do not delete each other's
    words; a row with a null id is neither reference nor query. Repeated rows get equal
    results. Columns of ``docs`` with the new names are replaced; others stay. Ids are integers.
    """
    ranges = repeated_ranges(docs, id_col, text_col, window).groupBy(F.col("id").alias("__sub_id"), F.col("tag").alias("__sub_tag")).agg(
        F.collect_set(F.array("start", "stop")).alias("__sub_ranges")
    )
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(ranges, (docs[id_col].cast("long") == F.col("__sub_id")) & (tag == F.col("__sub_tag")), "left")
    fields = T.StructType(
        [
            T.StructField("n_words", T.LongType(), False),
            T.StructField("n_removed", T.LongType(), False),
            T.StructField("kept_text", T.StringType(), False),
        ]
    )

    def make():
        def step(batch: pa.RecordBatch) -> list:
            counts, removed, texts = [], [], []
            for text, ranges in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()
                counts.append(len(words))
                at, kept = 0, []
                for start, stop in sorted(ranges.as_py() or ()):
                    kept += words[at:start]
                    at = max(at, stop)
                kept = kept + words[at:] if at else words
                removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept).decode())
            return [counts, removed, texts]

        return step

    return add_columns(joined, [F.col(text_col).cast("binary"), "__sub_ranges"], fields, make, docs.columns)


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)),
first AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS k FROM win JOIN first USING (g) WHERE first_id < doc_id),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM doc),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text
  FROM word ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)"""


@query(ORACLE)
def op5_substring_dedup(spark, sf_dir):
    """Words of every document that no earlier document's window covers."""
    done = remove_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
