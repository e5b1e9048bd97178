"""Ids of whole texts by the tokenizers library, each distinct piece once a slice.

Where a tokenizer's own splitting is one of two known kinds, texts of usual characters are cut at blanks
by Arrow, distinct chunks are found by Arrow too, and only chunks that the memo lacks are split into the
tokenizer's pieces and go to the library's model. Ids of whole texts are then gathered by array look-ups.
All other texts, and all texts of any other tokenizer, go to the library whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.common import USUAL_CHARACTERS, usual

_tokenizers: dict[str, object] = {}

#: Fixed values of the two public tokenizers: how they normalise and split.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORD_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_WORD_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}

#: Both tokenizers' patterns for usual characters, over chunks that a null character divides; the words
#: tokenizer's chunks are in lower case.
_WORDS = re.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s\x00]|_)+")
_BYTES = re.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s\x00]|_)+|\s+(?![^\s\x00])|\s+")
#: A blank within white space: there a text of the byte-level tokenizer may not be cut before it.
_INNER_BLANK = re.compile(r"\s (?:\s|\Z)")


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``flat`` one after another, and their edges."""
    ends = np.cumsum(size)
    edges = np.concatenate([[0], ends]).astype(np.int64)
    return flat[np.repeat(start - edges[:-1], size) + np.arange(edges[-1])], edges


class Memo:
    """Ids by key, in arrays: an Arrow array of keys, and ids one after another. A memo that would have
    over ``most`` keys keeps those of the last call only, the frequent ones among them."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self._make, self._most = make, most
        self._keys, self._ids, self._size = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self._keys)

    def look_up(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): the ids of each of ``keys``, which are distinct, are that range of ids."""
        found = pc.index_in(keys, value_set=self._keys)
        lacking, at = np.asarray(found.is_null()), np.asarray(found.fill_null(0))
        start, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        known = at[~lacking]
        start[~lacking], size[~lacking] = (np.cumsum(self._size) - self._size)[known], self._size[known]
        if not lacking.any():
            return self._ids, start, size
        new = keys.filter(pa.array(lacking))
        ids, sizes = self._make(new.to_pylist())
        start[lacking], size[lacking] = len(self._ids) + np.cumsum(sizes) - sizes, sizes
        ids = np.concatenate([self._ids, ids])
        if len(self) + len(new) <= self._most:
            self._keys, self._ids, self._size = pa.concat_arrays([self._keys, new]), ids, np.concatenate([self._size, sizes])
        else:
            keys = keys.slice(max(0, len(keys) - self._most))
            kept = slice(len(start) - len(keys), None)
            self._keys, self._ids, self._size = keys, _gathered(ids, start[kept], size[kept])[0], size[kept]
        return ids, start, size


@contextmanager
def no_collector():
    """Python's cyclic collector is of no use here, and costs much while many small objects live."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def splitting(spec: dict) -> str | None:
    """``bytes`` or ``words`` if a tokenizer's file has the known kind of splitting, else None."""

    def has(part: dict | None, fixed: dict) -> bool:
        return part is not None and all(part.get(k) == v for k, v in fixed.items())

    model, pre = spec["model"], spec.get("pre_tokenizer")
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("byte_fallback")
    if not plain or not all(t["special"] for t in spec.get("added_tokens") or []):
        return None
    if spec.get("normalizer") is None and has(pre, _BYTE_LEVEL):
        return "bytes"
    parts = (pre or {}).get("pretokenizers") or [None]
    if spec.get("normalizer") == _WORD_NORMALIZER and len(parts) == 2 and has(parts[0], _WORD_SPLIT) and has(parts[1], _WORD_LEVEL):
        return "words"
    return None


class PieceEncoder:
    """``encode`` gives the ids of texts as the tokenizers library would; ``max_memo`` bounds each of the
    two memos, of chunks and of pieces."""

    def __init__(self, path: str, max_memo: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # an executor's cores are shared out by Spark
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            self.kind = splitting(json.load(f))
        self._tokenize = self._tokenizer.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in USUAL_CHARACTERS} if self.kind else {}
        self._chunks, self._pieces = Memo(self._of_chunks, max_memo), Memo(self._of_pieces, max_memo)

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and each one's number; the dividing character has none."""
        tokenize, ids, sizes = self._tokenize, [], []
        for piece in pieces:
            own = [] if piece == "\0" else [t.id for t in tokenize(piece.translate(self._letters))]
            ids += own
            sizes.append(len(own))
        return np.array(ids, "<u4"), np.array(sizes, np.int64)

    def _of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(chunks)
        pieces = _BYTES.findall(joined) if self.kind == "bytes" else _WORDS.findall(joined.lower())
        found = pa.array(pieces, pa.large_string())
        divides = np.asarray(pc.equal(found, "\0"))
        del pieces
        distinct = found.dictionary_encode()
        ids, start, size = self._pieces.look_up(distinct.dictionary)
        at = np.asarray(distinct.indices)
        out, edges = _gathered(ids, start[at], size[at])
        return out, np.diff(np.concatenate([[0], edges[1:][divides], [len(out)]]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        by_chunk = [self._divisible(t) for t in texts]
        with no_collector():
            cut = iter(self._by_chunks([t for t, yes in zip(texts, by_chunk, strict=True) if yes]))
            return [next(cut) if yes else self._whole(t) for t, yes in zip(texts, by_chunk, strict=True)]

    def _divisible(self, text: str) -> bool:
        if self.kind is None or not usual(text):
            return False
        # the lower case of this letter is two characters, one of them not usual
        return not _INNER_BLANK.search(text) if self.kind == "bytes" else "İ" not in text

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        column = pa.array(texts, pa.large_string())
        lists = pc.split_pattern(column, " ") if self.kind == "bytes" else pc.ascii_split_whitespace(column)
        found, edges = lists.flatten().dictionary_encode(), np.asarray(lists.offsets).astype(np.int64)
        keys, at = found.dictionary, np.asarray(found.indices).astype(np.int64)
        if self.kind == "bytes":  # all chunks but a text's first one begin with the blank before them
            first = at[edges[:-1]]
            used = np.unique(first)
            at[edges[:-1]] = len(keys) + np.searchsorted(used, first)
            blank = pa.scalar(" ", pa.large_string())
            keys = pa.concat_arrays([pc.binary_join_element_wise(blank, keys, pa.scalar("", pa.large_string())), keys.take(pa.array(used))])
        ids, start, size = self._chunks.look_up(keys)
        out, ends = _gathered(ids, start[at], size[at])
        packed, bounds = out.tobytes(), (4 * ends[edges]).tolist()
        return [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python process for a tokenizer file."""
    if path not in _tokenizers:
        _tokenizers[path] = PieceEncoder(path)
    return _tokenizers[path]
