"""Prompt batches: JSON arrays, JSON lines, generated ones, and their preflight check."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.operators.prefix import MOST_BROADCAST_ROWS, group_starts, number_placed, running_sums
from promptloom.session import materialise, ship_package

BROKEN_BATCH = "batch is not a JSON array"

# Texts of the generated sample batch, picked by i modulo the list length.
TEMPLATES = (
    "Explain {topic} in one sentence.",
    "Summarize the key idea behind {topic}.",
    "Give three bullet points about {topic}.",
    "What is a common misconception about {topic}?",
    "Write a short tip for someone learning {topic}.",
    "Translate the word '{topic}' into French.",
    "Provide a simple analogy for {topic}.",
    "List two pros and two cons of {topic}.",
)
TOPICS = (
    "photosynthesis", "recursion", "the water cycle", "compound interest",
    "machine learning", "the French Revolution", "black holes", "REST APIs",
    "supply and demand", "DNA replication", "the internet", "vaccines",
    "quantum computing", "climate change", "blockchain", "the stock market",
    "neural networks", "gravity", "evolution", "encryption",
)

# Hadoop's names of object stores and those of the file-system library.
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+):(/.*)", re.S)
_STORES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "gs": "gs"}

# Messages of the preflight check.
NOT_FOUND = "input file not found: "
NOT_AN_ARRAY = "input file must be a JSON array"
UNREADABLE = "cannot read input file: "
NO_MODEL = "no model configured"

# Fixed value: bytes a preflight check looks at.
HEAD_BYTES = 64

PIECE_BYTES = 1 << 20

_BLANK = b" \t\r\n"
_QUOTE, _ESCAPE, _COMMA = b'"\\,'
_STEPS = np.zeros(256, np.int64)
_STEPS[list(b"[{")], _STEPS[list(b"]}")] = 1, -1

_CHUNK = "path string, split bigint, seq bigint, size bigint, data binary, bytes bigint, odd bigint, depth bigint, depth_inside bigint, filled bigint, alone boolean"
_KEYS = ["path", "split", "seq"]


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Elements of JSON-array files: (path, row_number, element VARIANT, batch_error).

    Every element is a row, whatever its kind, numbered from 1 within its file. A file that is
    no valid array yields one row with ``batch_error`` and no element: an empty file, text
    before or after the array, a missing bracket, bytes that are not UTF-8, or an element that
    is not strict JSON. Errors of the file system are raised.

    Files of any size are read the same way, from any store Spark reads, and are split. The
    source is scanned once: text is cut at closing braces into chunks, which are stored with
    their place in the file and with how they change the state of a scan (within a string,
    depth). All that follows works on the stored chunks, so it does not matter how Spark splits
    the files, nor whether executors come or go meanwhile. The state in which each chunk begins
    comes from running sums over the chunks of a file, spread over partitions: first of quotes,
    whose parity tells strings from the rest, then of the depth. A third one numbers the
    elements. A file that is one chunk, as most are, needs none of this: the same code cuts it
    from the state in which every file begins, in one pass. A task holds one chunk or one element
    at a time, and nothing is gathered on the driver but Spark's own list of files.
    """
    ship_package(spark)
    scan = spark.read.option("lineSep", "}").text(path)
    listed = scan.inputFiles()  # also the empty files, which no scan reads
    pieces = scan.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("value"),
    )
    chunks = materialise(pieces.mapInArrow(_chunks, _CHUNK), "chunks")
    # The list comes from the driver's file index, which is as long as the number of files.
    # It writes local paths as file:///x, rows name them file:/x.
    names = spark.createDataFrame([(name.replace("file:///", "file:/", 1),) for name in listed], "path string")
    unread = names.join(chunks.select("path").distinct(), "path", "left_anti")
    refused = unread.select("path", F.lit(BROKEN_BATCH).alias("batch_error"))
    found = _read_alone(chunks.where("alone")).unionByName(refused, allowMissingColumns=True)
    several = chunks.where("NOT alone")
    return found if several.isEmpty() else found.unionByName(_read_several(several))


def _read_alone(chunks: DataFrame) -> DataFrame:
    """``read_json_arrays`` of files that are one chunk each."""
    files = chunks.select("path", "size", "bytes", "data").mapInArrow(_cut_files, "path string, broken boolean, texts array<string>")
    parsed = files.select("path", "broken", F.transform("texts", _one_value).alias("elements"))
    numbered = F.transform(
        "elements",
        lambda element, at: F.struct((at + 1).cast("bigint").alias("row_number"), element.alias("element"), F.lit(None).cast("string").alias("batch_error")),
    )
    error = F.array(
        F.struct(F.lit(None).cast("bigint").alias("row_number"), F.lit(None).cast("variant").alias("element"), F.lit(BROKEN_BATCH).alias("batch_error"))
    )
    refused = F.col("broken") | F.exists("elements", lambda element: element.isNull())
    return parsed.select("path", F.inline(F.when(refused, error).otherwise(numbered)))


def _read_several(chunks: DataFrame) -> DataFrame:
    """``read_json_arrays`` of files of several chunks."""
    entered = _entry_states(chunks.drop("data"))
    texts = chunks.select(*_KEYS, "data")
    counted = materialise(
        texts.join(entered, _KEYS).mapInArrow(
            _count_elements, "path string, split bigint, seq bigint, closed bigint, filled boolean, broken boolean"
        ),
        "counted",
    )
    files = counted.groupBy("path").agg(
        F.sum("closed").alias("n"), F.bool_or("filled").alias("filled"), F.bool_or("broken").alias("broken")
    )
    broken = files.where("broken").select("path")
    whole = files.where("NOT broken AND (n > 1 OR filled)").select("path")  # others are empty arrays
    numbered = running_sums(counted.select(*_KEYS, "closed"), ["path"], ["split", "seq"], {"upto": "closed"})
    begin = entered.join(numbered.select(*_KEYS, (F.col("upto") - F.col("closed")).alias("before")), _KEYS)
    parts = texts.join(begin.join(whole, "path", "left_semi"), _KEYS).mapInArrow(
        _cut_elements, "path string, split bigint, seq bigint, row_number bigint, text string, whole boolean"
    )
    # Parsed as they are cut; only the text of elements that span chunks is kept.
    text = F.when(~F.col("whole"), F.col("text"))
    read = parse_elements(parts.select("*", text.alias("part")), "text").withColumn("valid", F.col("element").isNotNull())
    read = materialise(read, "elements")
    joined = (
        read.where("NOT whole")
        .groupBy("path", "row_number")
        .agg(F.array_sort(F.collect_list(F.struct("split", "seq", "part"))).alias("parts"))
        .select("path", "row_number", F.array_join("parts.part", "").alias("text"))
    )
    joined = materialise(parse_elements(joined, "text"), "joined")
    parsed = read.where("whole").select("path", "row_number", "element").unionByName(joined)
    invalid = read.where("whole AND NOT valid").select("path").unionByName(joined.where("element IS NULL").select("path"))
    refused = materialise(broken.unionByName(invalid).distinct(), "refused")
    few = refused.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS
    kept = parsed.join(F.broadcast(refused) if few else refused, "path", "left_anti").select(
        "path", "row_number", "element", F.lit(None).cast("string").alias("batch_error")
    )
    return kept.unionByName(refused.select("path", F.lit(BROKEN_BATCH).alias("batch_error")), allowMissingColumns=True)


def _entry_states(marks: DataFrame) -> DataFrame:
    """State in which each chunk begins: (…, inside, at_depth, begun, last, brace).

    ``begun``: there is text before it; ``last``: it is the file's last one; ``brace``: the brace
    that ends it stands in the file. The reader takes braces off, also one that ends a file,
    so the bytes read are one more than the file's unless it ends with a brace.
    """
    quotes = running_sums(marks, ["path"], ["split", "seq"], {"quotes": "odd", "read": "bytes", "texts": "filled"})
    inside = F.pmod(F.col("quotes") - F.col("odd"), F.lit(2)) == 1
    step = F.when(inside, F.col("depth_inside")).otherwise(F.col("depth"))
    known = quotes.select(*_KEYS, "size", "read", inside.alias("inside"), (F.col("texts") > F.col("filled")).alias("begun"), step.alias("step"))
    depths = running_sums(known, ["path"], ["split", "seq"], {"reached": "step"})
    ends = depths.groupBy("path").agg(F.max("read").alias("end"))
    last = F.col("read") == F.col("end")
    return materialise(
        depths.join(ends, "path").select(
            *_KEYS, "inside", (F.col("reached") - F.col("step")).alias("at_depth"), "begun",
            last.alias("last"), (~last | (F.col("end") == F.col("size"))).alias("brace"),
        ),
        "states",
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """About ``PIECE_BYTES`` of each split at a time, with braces put back, and what they change."""
    key, held, size, seq = None, [], 0, 0

    def packed() -> pa.RecordBatch:
        data = b"}".join(held) + b"}"
        quotes, brackets, steps = _structure(data)
        odd = np.searchsorted(quotes, brackets) & 1
        alone = key[1] == seq == 0 and len(data) >= key[2]
        row = (*key[:2], seq, key[2], data, len(data), len(quotes) & 1, int(steps[odd == 0].sum()), int(steps[odd == 1].sum()), int(bool(data[:-1].strip(_BLANK))), alone)
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [c.split()[0] for c in _CHUNK.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = group_starts([batch.column(0), batch.column(1)], batch.num_rows)
        starts[0] = True
        upto = np.cumsum(pc.binary_length(batch.column(3)).to_numpy().astype(np.int64) + 1)
        edges = [*np.flatnonzero(starts).tolist(), batch.num_rows]
        for at, stop in zip(edges, edges[1:], strict=False):
            found = [batch.column(i)[at].as_py() for i in range(3)]
            while at < stop:
                if key != found or size > PIECE_BYTES:
                    if key is not None:
                        yield packed()
                    seq = seq + 1 if key == found else 0
                    key, held, size = found, [], 0
                before = int(upto[at - 1]) if at else 0
                end = min(stop, int(np.searchsorted(upto, before + PIECE_BYTES - size, "right")) + 1)
                held += batch.column(3).slice(at, end - at).to_pylist()
                size += int(upto[end - 1]) - before
                at = end
    if key is not None:
        yield packed()


def _structure(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes that are not escaped, places of brackets, and what those add to the depth."""
    codes = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(codes == _QUOTE)
    slashes = np.flatnonzero(codes == _ESCAPE)
    if len(slashes) and len(quotes):
        # A quote is escaped by an odd number of backslashes right before it.
        first = np.concatenate([[True], slashes[1:] != slashes[:-1] + 1])
        begin = slashes[np.maximum.accumulate(np.where(first, np.arange(len(slashes)), 0))]
        at = np.searchsorted(slashes, quotes) - 1
        run = np.where((at >= 0) & (slashes[at] == quotes - 1), slashes[at] - begin[at] + 1, 0)
        quotes = quotes[run % 2 == 0]
    steps = _STEPS[codes]
    brackets = np.flatnonzero(steps)
    return quotes, brackets, steps[brackets]


def _boundaries(data: bytes, inside: bool, depth: int, begun: bool, last: bool) -> tuple[int, list[int], bool] | None:
    """Where the elements of a chunk begin, where they end, and whether the array is over.

    None if the file is no array; an empty list and True if the chunk lies outside the array.
    """
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if begun and depth <= 0 and not inside:
        return (0, [], True) if depth == 0 and not data.strip(_BLANK) else None
    start = 0
    if not begun:
        start = len(data) - len(data.lstrip(_BLANK))
        if start == len(data):
            return None if last else (0, [], True)
        if data[start : start + 1] != b"[":
            return None
    codes = np.frombuffer(data, np.uint8)
    quotes, brackets, steps = _structure(data)
    out = (np.searchsorted(quotes, brackets) + inside) & 1 == 0
    brackets, depths = brackets[out], depth + np.cumsum(steps[out])
    commas = np.flatnonzero(codes == _COMMA)
    commas = commas[(np.searchsorted(quotes, commas) + inside) & 1 == 0]
    held = np.searchsorted(brackets, commas)
    ends = commas[np.concatenate([[depth], depths])[held] == 1]
    closed = np.flatnonzero(depths <= 0)
    if not len(closed):
        return None if last else (start + (not begun), ends.tolist(), False)
    end = int(brackets[closed[0]])
    if codes[end] != ord("]") or data[end + 1 :].strip(_BLANK):
        return None
    return start + (not begun), [*ends[ends < end].tolist(), end], True


def _each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes, tuple | None]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
            data = row.pop("data") if row["brace"] else row.pop("data")[:-1]
            yield row, data, _boundaries(data, row["inside"], row["at_depth"], row["begun"], row["last"])


def _count_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk the elements that end in it, whether it has any text of elements, and faults."""
    rows = []
    for row, data, found in _each_chunk(batches):
        start, ends, over = found or (0, [], True)
        text = b"" if over and not ends else data[start : ends[-1] if over else len(data)]
        rows.append((row["path"], row["split"], row["seq"], len(ends), bool(text.strip(_BLANK)), found is None))
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
    names = ("path", "split", "seq", "closed", "filled", "broken")
    yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], t) for i, t in enumerate(types)], names)


def _cut_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of files that are one chunk each, or that they are no array."""
    for batch in batches:
        for at in range(batch.num_rows):
            path, size, read, data = (batch.column(name)[at].as_py() for name in ("path", "size", "bytes", "data"))
            data = data if read == size else data[:-1]
            found = _boundaries(data, False, 0, False, True)
            start, ends, _ = found or (0, [], True)
            texts = [data[a:b] for a, b in zip([start, *(end + 1 for end in ends)], ends, strict=False)]
            if len(texts) == 1 and not texts[0].strip(_BLANK):
                texts = []  # an empty array
            cut = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([found is None]), cut], ["path", "broken", "texts"])


def _cut_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements and parts of elements with their numbers."""
    for row, data, (start, ends, over) in _each_chunk(batches):
        if over and not ends:
            continue
        places = [start, *(end + 1 for end in ends)]
        texts = [data[a:b] for a, b in zip(places, [*ends, *([] if over else [len(data)])], strict=False)]
        # The first element began in an earlier chunk, unless the array begins here; the last
        # one goes on in the next chunk, unless the array ends here.
        whole = [True] * len(texts)
        whole[0] &= not row["begun"]
        whole[-1] &= over
        count = len(texts)
        columns = ([row["path"]] * count, [row["split"]] * count, [row["seq"]] * count, range(row["before"] + 1, row["before"] + 1 + count))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 3), strict=True)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(whole)],
            ["path", "split", "seq", "row_number", "text", "whole"],
        )


def _one_value(text: Column) -> Column:
    """The value of a JSON text, null where it is not one value.

    The parser stops after the first value; in brackets it has to read on to the end.
    """
    return F.variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$[0]", "variant")


def parse_elements(rows: DataFrame, column: str) -> DataFrame:
    """Replace a column of JSON texts by ``element`` (VARIANT), null where a text is not one value."""
    return rows.withColumn("element", _one_value(F.col(column))).drop(column)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Elements of JSON-lines files: (path, row_number, element). Files are split freely.

    Lines are numbered per file in file order: by split, then by place in the split. They are
    stored with both as they are read, so numbering them neither sorts nor shuffles any text.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )
    numbered = number_placed(materialise(lines, "lines"), ["path"], "_split", "_line", "row_number")
    return parse_elements(numbered, "value").select("path", "row_number", "element")


def sample_prompt(index: Column) -> Column:
    """Prompt number ``index`` of the generated batch."""

    def pick(values: tuple[str, ...]) -> Column:
        place = (F.pmod(index, F.lit(len(values))) + 1).cast("int")
        return F.element_at(F.array(*[F.lit(v) for v in values]), place)

    return F.replace(pick(TEMPLATES), F.lit("{topic}"), pick(TOPICS))


def sample_items(numbers: DataFrame, index: str) -> DataFrame:
    """Generated items, one for each number in column ``index``: (row_number, external_id, prompt)."""
    number = F.col(index).cast("bigint")
    return numbers.select(
        number.alias("row_number"),
        F.format_string("prompt-%04d", number).alias("external_id"),
        sample_prompt(number).alias("prompt"),
    )


def sample_batch(spark: SparkSession, count: int) -> DataFrame:
    """The generated batch with rows 1 … ``count``."""
    return sample_items(spark.range(1, count + 1), "id")


def _head(path: str) -> tuple[str, bytes, str | None]:
    """State of a path (found / missing / unreadable) and its first bytes."""
    # Hadoop writes paths without an authority as file:/x or hdfs:/x; the URI form needs three slashes.
    scheme, rest = found.groups() if (found := _SCHEME.match(path)) else ("file", path)
    try:
        if scheme == "file":
            system, inner = fs.LocalFileSystem(), re.sub(r"^/{2,}", "/", rest)
        else:
            rest = rest if rest.startswith("//") else f"//{rest}"
            system, inner = fs.FileSystem.from_uri(f"{_STORES.get(scheme, scheme)}:{rest}")
        if system.get_file_info(inner).type != fs.FileType.File:
            return "missing", b"", None
        with system.open_input_stream(inner) as stream:
            return "found", stream.read(HEAD_BYTES), None
    except (OSError, ValueError, NotImplementedError) as error:
        # Also a store or a name that the library does not know: other batches are still checked.
        return "unreadable", b"", str(error)


def check_sources(manifest: DataFrame, default_model: str | None = None) -> DataFrame:
    """Check submitted batches before any is read: adds ``errors`` (array) and ``ok``.

    Needs ``input_path`` and ``model``. Only the first bytes of each file are fetched, by the
    task that holds its manifest row, so many batches are checked at once.
    """
    ship_package(manifest.sparkSession)
    columns = manifest.columns
    schema = T.StructType(
        [
            *manifest.schema.fields,
            T.StructField("_state", T.StringType()),
            T.StructField("_head", T.BinaryType()),
            T.StructField("_why", T.StringType()),
        ]
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [_head(path) if path else ("missing", b"", None) for path in batch.column("input_path").to_pylist()]
            state, head, why = (list(part) for part in zip(*seen, strict=True)) if seen else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(state, pa.string()), pa.array(head, pa.binary()), pa.array(why, pa.string())],
                names=[*columns, "_state", "_head", "_why"],
            )

    looked = manifest.mapInArrow(look, schema)
    blank = F.lit(" \t\n\r\x0b\x0c")
    first = F.ltrim(F.decode(F.col("_head"), "ISO-8859-1"), blank)
    model = F.coalesce(F.nullif("model", F.lit("")), F.lit(default_model), F.lit(""))
    messages = F.array(
        F.when(F.col("_state") == "missing", F.concat(F.lit(NOT_FOUND), F.coalesce("input_path", F.lit("")))),
        F.when((F.col("_state") == "found") & ~first.startswith("["), F.lit(NOT_AN_ARRAY)),
        F.when(F.col("_state") == "unreadable", F.concat(F.lit(UNREADABLE), F.col("_why"))),
        F.when(model == "", F.lit(NO_MODEL)),
    )
    return looked.select(*columns, F.array_compact(messages).alias("errors")).withColumn("ok", F.size("errors") == 0)
