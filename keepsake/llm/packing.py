"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import result_texts

END_ID = 2
MAX_LENGTH = 1024
# Bins a task keeps open. More fit a little better, and leave more bins unfilled per task.
OPEN_BINS = 256


class OpenBins:
    """Open bins by free space: a bitset of the spaces that occur, and the bins of each."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.spaces, self.bins, self.count, self.opened = 0, [[] for _ in range(capacity + 1)], 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece: the least free space that suffices, else a new bin."""
        fitting = self.spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.bins[left].append(number)
            self.spaces |= 1 << left
            self.count += 1
            if self.count > self.limit:  # the fullest closes first
                self._take((self.spaces & -self.spaces).bit_length() - 1)
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.spaces ^= 1 << free
        self.count -= 1
        return number


def _bytes_of_symbols() -> dict[str, int]:
    """Byte for each printable stand-in that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_encoder(tokenizer_path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizers library gives them, without added special tokens.

    Texts of Latin letters only, without special tokens, take a faster encoder over the same
    vocabulary if its ids are merge ranks; both give equal ids there (tested). All
    others are left to the library.
    """
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    library.no_truncation()
    library.no_padding()
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [token["content"] for token in spec["added_tokens"]]
    vocabulary = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
    slow = lambda text: np.asarray(library.encode(text, add_special_tokens=False).ids, np.uint32)
    plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or [vocabulary[m] for m in merged] != list(range(256, 256 + len(merged))):
        return slow
    symbols = _bytes_of_symbols()
    ranks = {bytes(symbols[c] for c in token): i for token, i in vocabulary.items()}
    # Fixed value: how the library cuts text before merging.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    other = regex.compile("[^\\x00-\\u024F]|" + "|".join(map(regex.escape, special)))

    def encode(text: str) -> np.ndarray:
        if other.search(text):
            return slow(text)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """Start and length of pieces: whole if it fits, else full pieces after a first rest."""
    if length <= most:
        return [(0, length)]
    first = length % most or most
    return [(0, first)] + [(at, most) for at in range(first, length, most)]


def pack_results(results: DataFrame, tokenizer_path: str, max_length: int = MAX_LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Texts of semantic results as token pieces, packed into sequences of ``max_length``.

    Reads ``object_id, result_text``. A text becomes its ids and a final id 2; only longer
    ones are cut into pieces of ``max_length``, of which the first may be shorter. Returns one
    row per piece: object_id, piece, start, length, ``token_ids`` (little-endian unsigned
    32-bit), sequence_id, offset. Each task packs what it reads into its own sequences,
    online, with ``open_bins`` open bins at most; so nothing is shuffled, no key can be hot,
    and at most that many bins per task stay unfilled.

    Null and empty texts are a single id 2. Repeated rows and null object_ids are packed like
    any others. An empty table gives no rows. Other columns are not read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(tokenizer_path)
        bins = OpenBins(max_length, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, piece, start, length, ids, number, offset = [], [], [], [], [], [], []

            def flush() -> pa.RecordBatch:
                long = lambda values: pa.array(values, pa.int64())
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), long(start), long(length),
                     pa.array(ids, pa.binary()), long(number), long(offset)],
                    ["object_id", "piece", "start", "length", "token_ids", "sequence_id", "offset"])
                for column in (rows, piece, start, length, ids, number, offset):
                    column.clear()
                return out

            size = 0
            for row, text in enumerate(batch.column(1)):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for k, (at, n) in enumerate(cut(len(tokens), max_length)):
                    place = bins.place(n)
                    for column, value in ((rows, row), (piece, k), (start, at), (length, n), (ids, tokens[at : at + n].tobytes()),
                                          (number, base + place[0]), (offset, place[1])):
                        column.append(value)
                size += len(tokens)
                if size > 1_000_000:
                    yield flush()
                    size = 0
            yield flush()

    texts = result_texts(results)
    schema = T.StructType([
        texts.schema["object_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("token_ids", T.BinaryType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    return texts.mapInArrow(pack, schema)
