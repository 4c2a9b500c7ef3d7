"""Token ids of whole texts by a public tokenizer, one binary value per document.

Ids are stored as little-endian unsigned integers, two bytes each where the
vocabulary allows it. Where a tokenizer never lets a token cross white space
(a probe decides), a text is encoded word by word through a bounded cache of
words, which gives the same ids as encoding the whole text.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import compress, count, islice, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_WORDS = 600_000
PIECE_BYTES = 5 << 20
# A letter that may compose with a mark; of some (H, T, W, Y, J) only the small form does.
MARKED = r"[A-Z]\p{M}"
PROBE = "Ab, c1\t'sx  \nÉ.d  ḗ q"
_ENCODERS: dict[str, "CachedEncoder"] = {}


def default_tokenizer() -> str:
    """Path of the public word-level BPE vocabulary on this machine."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class CachedEncoder:
    """Encode texts with one tokenizer; one object per worker process and path."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"  # native order; x86 and ARM are little-endian
        self.special = [str(token.content).encode()
                        for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.letters = self._byte_letters()
        parts = [self._whole(word) for word in PROBE.encode().split()]
        self.by_word = (self._whole(PROBE.encode()) == b"".join(parts)
                        and self._whole(b" \n") == b""
                        and not any(len(token.split()) != 1 for token in self.special))
        self.folds_case = self._whole(b"AbcXYZ") == self._whole(b"abcxyz")

    def _byte_letters(self) -> dict[int, str] | None:
        """The letter that stands for each byte of a plain word, if only that step changes such a word."""
        from tokenizers import pre_tokenizers
        told = json.loads(self.tokenizer.to_str())
        steps = (told.get("normalizer") or {}).get("normalizers", [])
        cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if ([step["type"] for step in steps] != ["NFC", "Replace", "Lowercase"]
                or [cut["type"] for cut in cuts] != ["Split", "ByteLevel"]
                or "|[\\p{L}]+|" not in cuts[0]["pattern"].get("Regex", "")):
            return None
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        samples = [*range(0x80, 0x800), 0x800, *range(0x1000, 0xF001, 0x1000), 0x10000, 0x40000, 0x80000,
                   0xC0000, 0x100000]
        letters: dict[int, str] = {}
        for sample in map(chr, samples):
            letters.update(zip(sample.encode(), shown.pre_tokenize_str(sample)[0][0]))
        return letters

    def _encode_words(self, words: list[bytes]) -> None:
        """Add the ids of words; plain lower-case ones go to the model directly."""
        rest = words
        if self.letters is not None:
            tokenize, pack, known, rest = self.tokenizer.model.tokenize, self._pack, self.known, []
            for word in words:
                if word.isalpha() and word.islower():
                    text = word.decode()
                elif self._is_plain(word):
                    text = word.decode("latin-1").translate(self.letters)
                else:
                    rest.append(word)
                    continue
                known[word] = pack([token.id for token in tokenize(text)])
        if rest:
            encoded = self.tokenizer.encode_batch_fast(
                [word.decode("utf-8", "replace") for word in rest], add_special_tokens=False)
            self.known.update(zip(rest, [self._pack(item.ids) for item in encoded]))

    @staticmethod
    def _is_plain(word: bytes) -> bool:
        """Letters only, in lower case and in normal form."""
        if word.isascii():
            return False
        text = word.decode("utf-8", "replace")
        return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)

    def _whole(self, raw: bytes) -> bytes:
        return self._pack(self.tokenizer.encode(raw.decode("utf-8", "replace"),
                                                add_special_tokens=False).ids)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, missing: set[bytes]) -> None:
        """Add the ids of new words; a full cache keeps its older half, where the frequent words are."""
        if len(self.known) + 2 * len(missing) > CACHED_WORDS:
            self.known = dict(islice(self.known.items(), CACHED_WORDS // 2))
        known = self.known
        known[b""] = b""
        # A full stop or comma after an ASCII letter is a token of its own.
        marked = [word for word in missing if word.endswith((b".", b",")) and word[-2:-1].isalpha()]
        stems = missing.difference(marked).union((word[:-1] for word in marked), (b".", b","))
        self._encode_words([word for word in stems if word not in known])
        for word in marked:
            known[word] = known[word[:-1]] + known[word[-1:]]

    def _words(self, raw: bytes) -> list[bytes]:
        if not self.folds_case or any(token in raw for token in self.special):
            return raw.split()
        text = pa.array([raw.decode("utf-8", "replace")], pa.large_string())
        return self._folded(text).cast(pa.large_binary())[0].as_py().split()

    @staticmethod
    def _folded(texts: pa.Array) -> pa.Array:
        """Texts with A-Z in lower case, but as they are where a mark follows such a letter.

        The tokenizer composes letters and marks before it folds case.
        """
        lower = pc.ascii_lower(texts)
        marked = pc.match_substring_regex(texts, MARKED)
        return pc.if_else(marked, texts, lower) if pc.any(marked).as_py() else lower

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        ids, ends = self.encode_array(pa.array([text.decode("utf-8", "replace") for text in texts], pa.string()))
        return [part.tobytes() for part in np.split(ids, ends[:-1])] if texts else []

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text ends.

        Words are told apart by Arrow; only the distinct ones of the batch are
        looked up or encoded, and their ids are gathered in word order.
        """
        if not self.by_word or any(pc.any(pc.match_substring(texts, token.decode())).as_py()
                                   for token in self.special):
            parts = [self._one(raw) for raw in texts.cast(pa.binary()).to_pylist()]
            ends = np.cumsum([len(part) // self.dtype.itemsize for part in parts], dtype=np.int64)
            return np.frombuffer(b"".join(parts), self.dtype), ends
        split = pc.ascii_split_whitespace(self._folded(texts) if self.folds_case else texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        found = self._ids_of(words)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        starts = np.cumsum(lengths) - lengths
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = lengths[codes]
        done = np.cumsum(sizes)
        total = int(done[-1]) if len(done) else 0
        narrow = np.int32 if total < 1 << 31 else np.int64
        places = np.repeat((starts[codes] - (done - sizes)).astype(narrow), sizes)
        places += np.arange(total, dtype=narrow)
        bounds = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        return (np.frombuffer(b"".join(found), self.dtype)[places],
                np.concatenate([[0], done])[bounds])

    def _one(self, raw: bytes) -> bytes:
        return b"".join(self._ids_of(self._words(raw))) if self.by_word else self._whole(raw)

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of words; new ones are encoded together."""
        found = list(map(self.known.get, words))
        places = list(compress(count(), map(is_, found, repeat(None))))
        if places:
            self._learn({words[k] for k in places})
            for k in places:
                found[k] = self.known[words[k]]
        return found


def encoder(path: str) -> CachedEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def pieces_of(batch: pa.RecordBatch, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each; a longer text is alone."""
    held = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = int(held[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(held, before + size, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def token_table(docs: DataFrame, end_id: int, path: str | None = None) -> DataFrame:
    """(doc_id, ids binary, width int, n_tokens long) of every text, ``end_id`` appended.

    A null text counts as empty, so every row gives one row; other columns of
    ``docs`` are ignored.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        end = np.array([end_id], known.dtype)
        if int(end[0]) != end_id:
            raise ValueError("The end id does not fit the width of the ids")
        last, width = end.tobytes(), known.dtype.itemsize
        for batch in batches:
            for piece in pieces_of(batch):
                flat, ends = known.encode_array(piece.column("text"))
                begins = np.concatenate([[0], ends])
                ids = [flat[a:b].tobytes() + last for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(ids, pa.binary()),
                     pa.array([width] * len(ids), pa.int32()),
                     pa.array([len(item) // width for item in ids], pa.int64())],
                    names=["doc_id", "ids", "width", "n_tokens"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(run, "doc_id long, ids binary, width int, n_tokens long"))


def as_ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")
