"""Fill-in-the-middle: texts rearranged through a piece table.

A text is never edited. It is a list of *descriptors* (buffer, start, length) over two
immutable buffers: its own bytes, and the three sentinels. Cutting splits a descriptor,
an arrangement permutes descriptors, and the inverse permutation restores the text from the
rearranged output alone. Outputs and hashes stream over the descriptors, part by part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import result_texts

TEXT, SENTINELS = 0, 1
MARKS = (b"<P>", b"<S>", b"<M>")
SENTINEL_BYTES = b"".join(MARKS)
# Order of the parts prefix 0, suffix 1 and middle 2 in the output, each behind its sentinel.
# In spm the prefix stands behind the suffix.
ARRANGEMENTS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
PLAIN = "plain"
FIM_PERCENT, SPM_PERCENT, SEED = 50, 80, 42
# Output is handed on in batches of about this many bytes.
BATCH_BYTES = 8 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

Descriptor = tuple[int, int, int]


def split(pieces: list[Descriptor], at: int) -> tuple[list[Descriptor], list[Descriptor]]:
    """The descriptors before and behind byte ``at`` of what they describe."""
    before, behind = [], []
    for buffer, start, length in pieces:
        here = min(max(at, 0), length)
        if here:
            before.append((buffer, start, here))
        if here < length:
            behind.append((buffer, start + here, length - here))
        at -= length
    return before, behind


def sentinel(part: int) -> Descriptor:
    return SENTINELS, sum(len(mark) for mark in MARKS[:part]), len(MARKS[part])


def arrange(parts: list[list[Descriptor]], form: str) -> list[Descriptor]:
    """Descriptors of the output: parts in the order of the form, each behind its sentinel."""
    return [piece for part in ARRANGEMENTS[form] for piece in (sentinel(part), *parts[part])]


def restored(output: bytes, form: str) -> list[Descriptor]:
    """Descriptors of the text over an output: its parts by sentinel, in the order of a text.

    Parts hold no sentinel, and no sentinel overlaps another or itself, so each is found once.
    """
    if form == PLAIN:
        return [(TEXT, 0, len(output))] if output else []
    order = ARRANGEMENTS[form]
    marks = [output.index(MARKS[part]) for part in order]
    ends = [*marks[1:], len(output)]
    spans = {part: (TEXT, at + len(MARKS[part]), end - at - len(MARKS[part])) for part, at, end in zip(order, marks, ends)}
    return [spans[part] for part in (0, 2, 1) if spans[part][2]]


def read(pieces: list[Descriptor], text: bytes) -> Iterator[memoryview]:
    buffers = (memoryview(text), memoryview(SENTINEL_BYTES))
    return (buffers[buffer][start : start + length] for buffer, start, length in pieces)


def streamed_sha256(pieces: list[Descriptor], text: bytes) -> str:
    digest = hashlib.sha256()
    for part in read(pieces, text):
        digest.update(part)
    return digest.hexdigest()


def token_ends(data: bytes) -> np.ndarray:
    """Byte ends of the tokens: a word with the white space before it, or white space at the end."""
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    return np.append(ends, len(data)) if len(data) and blank[-1] else ends


def characters(data: memoryview) -> int:
    """Code points of a UTF-8 string."""
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four numbers of a record: the first four 32-bit groups of the hash of seed and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def _bytes_of(column: pa.Array) -> Iterator[bytes]:
    """Values as UTF-8 bytes, null as none; nothing is decoded."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def _array(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.binary()).cast(kind) if values and isinstance(values[0], bytes) else pa.array(values, kind)


def fill_in_middle(results: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Texts of semantic results rearranged for fill-in-the-middle training.

    Reads ``object_id, result_text``. A text is cut into tokens (a word with the white space
    before it; white space at the end). Four numbers drawn from the seed and the object_id
    decide: two of them the tokens at which prefix and middle end, the third whether the text
    stays plain, the fourth its form. Returns per input row: object_id, n_tokens, form
    (``plain``, ``psm``, ``spm``), prefix_chars, middle_chars (code points; null if plain),
    ``pieces`` (buffer 0 the text, 1 the sentinels; start, length in bytes), ``output_text``
    and output_sha256, the hash streamed over the pieces. ``restore_texts`` undoes it.

    Null and empty texts are plain with empty output. Texts that hold a sentinel are plain,
    so restoring is exact. A prefix, middle or suffix may be empty. A null object_id draws
    from the empty key. Rows that repeat come out alike. An empty table gives no rows. Other
    columns are not read. Rows are independent: nothing is shuffled, no key can be hot.
    """

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in out_fields]
            size = first = 0

            def flush(end: int) -> pa.RecordBatch:
                arrays = [batch.column("object_id").slice(first, end - first)]
                arrays += [_array(values, field.type) for values, field in zip(columns, out_fields)]
                for column in columns:
                    column.clear()
                return pa.RecordBatch.from_arrays(arrays, names)

            for row, (text, key) in enumerate(zip(_bytes_of(batch.column("result_text")), batch.column("key").to_pylist())):
                ends = token_ends(text)
                n = len(ends)
                h1, h2, h3, h4 = draws(seed, key)
                pieces, form, counts = [(TEXT, 0, len(text))] if text else [], PLAIN, (None, None)
                if text and h3 % 100 < fim_percent and not any(mark in text for mark in MARKS):
                    form = "spm" if h4 % 100 < spm_percent else "psm"
                    low, high = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    head, suffix = split(pieces, high)
                    prefix, middle = split(head, low)
                    counts = tuple(sum(map(characters, read(part, text))) for part in (prefix, middle))
                    pieces = arrange([prefix, suffix, middle], form)
                described = [{"buffer": b, "start": s, "length": k} for b, s, k in pieces]
                values = (n, form, *counts, described, b"".join(read(pieces, text)), streamed_sha256(pieces, text))
                for column, value in zip(columns, values):
                    column.append(value)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield flush(row + 1)
                    size, first = 0, row + 1
            yield flush(batch.num_rows)

    texts = result_texts(results).withColumn("key", F.coalesce(F.col("object_id").cast("string"), F.lit("")))
    piece = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
    out_fields = [
        pa.field("n_tokens", pa.int64()), pa.field("form", pa.string()), pa.field("prefix_chars", pa.int64()),
        pa.field("middle_chars", pa.int64()), pa.field("pieces", pa.list_(piece)), pa.field("output_text", pa.string()),
        pa.field("output_sha256", pa.string()),
    ]
    names = ["object_id", *[field.name for field in out_fields]]
    long = T.LongType()
    pieces_type = T.ArrayType(T.StructType([T.StructField("buffer", T.IntegerType()), T.StructField("start", long), T.StructField("length", long)]))
    schema = T.StructType([
        texts.schema["object_id"], T.StructField("n_tokens", long), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", long), T.StructField("middle_chars", long), T.StructField("pieces", pieces_type),
        T.StructField("output_text", T.StringType()), T.StructField("output_sha256", T.StringType())])
    return texts.mapInArrow(rearrange, schema)


def restore_texts(arranged: DataFrame) -> DataFrame:
    """The texts behind ``output_text`` and ``form``, by the inverse permutation.

    Adds ``result_text`` and ``text_sha256`` (streamed over the descriptors of the output) to
    the rows of ``fill_in_middle``, of which ``output_text`` is left out. A text that was
    null comes back as the empty text it was taken for. No rows give no rows.
    """

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = [], []
            for output, form in zip(_bytes_of(batch.column("output_text")), batch.column("form").to_pylist()):
                pieces = restored(output, form)
                texts.append(b"".join(read(pieces, output)))
                hashes.append(streamed_sha256(pieces, output))
            arrays = [batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays([*arrays, _array(texts, pa.string()), pa.array(hashes, pa.string())], names)

    kept = [c for c in arranged.columns if c not in ("output_text", "result_text", "text_sha256")]
    names = [*kept, "result_text", "text_sha256"]
    schema = T.StructType([*[arranged.schema[c] for c in kept], T.StructField("result_text", T.StringType()), T.StructField("text_sha256", T.StringType())])
    return arranged.select(*kept, "output_text").mapInArrow(restore, schema)
