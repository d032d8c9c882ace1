"""BPE encoding by forced boundaries, and decoding."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import result_texts
from .packing import _bytes_of_symbols

# Encoded words and fragments a task remembers; when full, it starts afresh.
REMEMBERED = 400_000


class BoundaryEncoder:
    """Encodes with a word-end BPE vocabulary, fragment by fragment.

    Merging builds tokens of the vocabulary only. Two neighbouring bytes that stand next to
    each other inside no token can therefore never be merged across, whatever the merge
    order: the cut between them is certain. A word is split at all such pairs, its
    fragments are encoded independently, and their ids are concatenated. The last fragment
    carries the mark of a word end, so pairs with a marked byte are counted apart.
    """

    def __init__(self, tokenizer_path: str):
        import regex
        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_file(tokenizer_path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(tokenizer_path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.final = models.BPE(vocab=vocabulary, merges=merges, end_of_word_suffix=self.end)
        self.inner = models.BPE(vocab=vocabulary, merges=merges)
        specials = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.specials = specials
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.symbol = {byte: char for char, byte in _bytes_of_symbols().items()}
        inside: set[str] = set()
        for token in vocabulary:
            if token in specials:
                continue
            marked = bool(self.end) and token.endswith(self.end) and token != self.end
            stem = token[: -len(self.end)] if marked else token
            pairs = [stem[i : i + 2] for i in range(len(stem) - 1)]
            if marked and pairs:
                pairs[-1] += self.end
            inside.update(pairs)
        self.inside = inside
        # Fixed value: how words are found in normalised text.
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.space = regex.compile(r"\s+")
        self.other = regex.compile("[^\\x00-\\u024F]")
        self.words: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.pieces = {i: t for t, i in self.library.get_vocab().items()}

    def split(self, symbols: str) -> list[str]:
        """Fragments of a word between certain cuts."""
        at, out, last = 0, [], len(symbols) - 1
        for i in range(last):
            pair = symbols[i : i + 2] + (self.end if i + 1 == last else "")
            if pair not in self.inside:
                out.append(symbols[at : i + 1])
                at = i + 1
        out.append(symbols[at:])
        return out

    def _fragment(self, fragment: str, final: bool) -> tuple[int, ...]:
        ids = self.fragments.get((fragment, final))
        if ids is None:
            if len(self.fragments) >= REMEMBERED:
                self.fragments.clear()
            model = self.final if final else self.inner
            ids = self.fragments[fragment, final] = tuple(token.id for token in model.tokenize(fragment))
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        fragments = self.split("".join(self.symbol[b] for b in word.encode("utf-8")))
        ids = sum((self._fragment(f, False) for f in fragments[:-1]), ()) + self._fragment(fragments[-1], True)
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        self.words[word] = ids
        return ids

    def _found(self, text: str) -> list[str]:
        """Words of normalised text. Latin text is normalised here, any other by the library."""
        if self.other.search(text):
            normal = self.library.normalizer.normalize_str(text)
            symbol = _bytes_of_symbols()
            cut = self.library.pre_tokenizer.pre_tokenize_str(normal)
            return [bytes(symbol[c] for c in piece).decode("utf-8", "surrogatepass") for piece, _ in cut]
        return self.word.findall(self.space.sub(" ", unicodedata.normalize("NFC", text)).lower())

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.words
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        for part in parts:
            if part in self.specials:
                ids.append(self.specials[part])
                continue
            for word in self._found(part):
                found = known.get(word)
                ids.extend(self._word(word) if found is None else found)
        return ids

    def decode(self, ids: list[int]) -> str:
        """As the library decodes, special tokens included."""
        if self.library.decoder is not None:
            return self.library.decode(ids, skip_special_tokens=False)
        pieces = self.pieces
        return " ".join([pieces[i] for i in ids])


def encode_results(results: DataFrame, tokenizer_path: str) -> DataFrame:
    """Texts of semantic results encoded and decoded again.

    Reads ``object_id, result_text`` and returns per input row: object_id, n_tokens,
    ``token_ids`` (little-endian unsigned 32-bit) and ``decoded``. One pass, no shuffle; a
    task keeps bounded tables of words and fragments it has met.

    Null and empty texts have no ids and decode to empty text. Repeated rows are encoded each
    for itself, a null object_id is carried through, an empty table gives no rows, other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BoundaryEncoder(tokenizer_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [encoder.encode(text.as_py() or "") for text in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([np.asarray(x, "<u4").tobytes() for x in ids], pa.binary()),
                     pa.array([encoder.decode(x) for x in ids], pa.string())],
                    ["object_id", "n_tokens", "token_ids", "decoded"])

    texts = result_texts(results)
    schema = T.StructType([
        texts.schema["object_id"], T.StructField("n_tokens", T.LongType()),
        T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType()),
    ])
    return texts.mapInArrow(run, schema)
