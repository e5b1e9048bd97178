"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly if each neighbouring pair
is compatible, that is, encoding the pair's bytes gives the pair back. That makes a nondeterministic
transducer: its places are (last whole token, node in the trie of tokens), and on reaching a token's
node it may end that token if it is compatible with the last one. ``BpeTransducer`` determinises it
on demand: a state holds all live places, each with the tokens that it has not yet sent; what all
places agree on is sent at once. A place dies when its bytes leave the trie, so tokens wait for at
most as many bytes as the longest token has. States and transitions are made when first met; when
there are too many they are forgotten and made again, so memory is bounded.

Decoding. ``Utf8Machine`` takes the tokens' bytes one at a time and gives whole code points as soon
as they end; ``decode_bytes`` steps it only where a token isn't whole UTF-8 by itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, text_column, usual

#: The split pattern for which a faster equivalent is known (fixed value of the public tokenizers).
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


class Splitter:
    """Matches of a tokenizer's split pattern. Usual texts take Python's re, others the regex library."""

    def __init__(self, pattern: str):
        import regex

        white = r"\t-\r \x85\xa0  -     　"
        spelt = pattern.replace(r"[^\s", f"[^{white}").replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]")
        self._exact, self._fast = regex.compile(spelt), _FAST if pattern == KNOWN_PATTERN else None

    def __call__(self, text: str) -> list[str]:
        if self._fast is not None and usual(text):
            return self._fast.findall(text)
        return [m.group() for m in self._exact.finditer(text)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class BpeTransducer:
    """Encodes byte strings by BPE ranks.

    ``max_states`` bounds the determinised part that is kept. Empty input gives no ids.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._step: dict[int, int] = {}
        self._ends: dict[int, int] = {}
        self._inner: set[int] = set()
        nodes = 1
        for token, rank in ranks.items():
            at = 0
            for b in token:
                self._inner.add(at)
                key = at << 8 | b
                if key not in self._step:
                    self._step[key] = nodes
                    nodes += 1
                at = self._step[key]
            self._ends[at] = rank
        self._spines: dict[int, tuple[list, list] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, 0, ()),)
        self._states, self._ids, self._moves = [start], {start: 0}, {}

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The pair whose merge makes ``token``, or None if merging its bytes doesn't end in it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] >= 1 << 62:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _spine(self, rank: int) -> tuple[list, list] | None:
        """Pieces at the left and right edge while a token is merged: (bytes, rank at which it is used up)."""
        if rank in self._spines:
            return self._spines[rank]
        token = self.bytes_of[rank]
        edges = []
        for side in (0, 1):
            edge, piece, until = [], token, 1 << 62
            while True:
                edge.append((piece, until))
                if len(piece) == 1:
                    break
                halves = self._split(piece)
                if halves is None or halves[0] not in self.ranks or halves[1] not in self.ranks:
                    self._spines[rank] = None
                    return None
                until, piece = self.ranks[piece], halves[side]
            edges.append(edge)
        self._spines[rank] = (edges[0], edges[1])
        return self._spines[rank]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together encode to these two tokens.

        They don't if some piece at the inner edge of each can merge across: both are there at that
        rank, a merge inside the left token at the same rank comes first and one inside the right
        token comes after.
        """
        key = (left, right)
        if (known := self._fits.get(key)) is not None:
            return known
        a, b, ok = self._spine(left), self._spine(right), True
        if a is None or b is None:
            ok = False
        else:
            for x, x_until in a[1]:
                for y, y_until in b[0]:
                    rank = self.ranks.get(x + y)
                    if rank is not None and rank < x_until and rank <= y_until:
                        ok = False
                        break
                if not ok:
                    break
        if len(self._fits) > 1_000_000:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        places, step, ends, inner, fits = [], self._step, self._ends, self._inner, self._fits
        for last, node, unsent in self._states[state]:
            to = step.get(node << 8 | byte)
            if to is None:
                continue
            if to in inner:
                places.append((last, to, unsent))
            token = ends.get(to)
            if token is not None:
                fit = fits.get((last, token))
                if fit is None:
                    fit = self.compatible(last, token) if last >= 0 else self._spine(token) is not None
                if fit:
                    places.append((token, 0, (*unsent, token)))
        if not places:
            raise ValueError("the ranks lack a byte of the input")
        sent = places[0][2]
        for _, _, unsent in places:
            if not sent:
                break
            if unsent[: len(sent)] != sent:
                n = 0
                while n < len(unsent) and unsent[n] == sent[n]:
                    n += 1
                sent = sent[:n]
        n = len(sent)
        # places come in the order of their start, so equal sets nearly always are equal tuples
        key = tuple((last, node, unsent[n:]) for last, node, unsent in places) if n else tuple(places)
        to = self._ids.get(key)
        if to is None:
            to = self._ids[key] = len(self._states)
            self._states.append(key)
        self._moves[state << 8 | byte] = (to, sent)
        return to, sent

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self._states) > self.max_states:
            self._reset()
        out, state, moves = [], 0, self._moves
        for n, byte in enumerate(data):
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
                if len(self._states) > 2 * self.max_states and n & 1023 == 0:  # within a very long match
                    here = self._states[move[0]]
                    self._reset()
                    moves, to = self._moves, self._ids.setdefault(here, len(self._states))
                    if to == len(self._states):
                        self._states.append(here)
                    move = (to, move[1])
            state = move[0]
            if move[1]:
                out += move[1]
        for _, node, unsent in self._states[state]:
            if node == 0:
                out += unsent
                return out
        raise ValueError("the input has no encoding")


class Utf8Machine:
    """Incremental UTF-8: feed bytes, get whole code points; ill-formed input gives U+FFFD each.

    A state is (bytes still to come, least and greatest value of the next one).
    """

    def __init__(self):
        self._held, self._need, self._low, self._high = bytearray(), 0, 0x80, 0xBF

    @property
    def pending(self) -> bytes:
        return bytes(self._held)

    def feed(self, data: bytes) -> str:
        out, whole = [], bytearray()
        for b in data:
            if self._need:
                if self._low <= b <= self._high:
                    self._held.append(b)
                    self._need, self._low, self._high = self._need - 1, 0x80, 0xBF
                    if not self._need:
                        whole += self._held
                        self._held.clear()
                    continue
                out.append(whole.decode() + "�")
                whole.clear()
                self._held.clear()
                self._need, self._low, self._high = 0, 0x80, 0xBF
            if b < 0x80:
                whole.append(b)
            elif 0xC2 <= b <= 0xF4:
                self._held.append(b)
                self._need = 1 + (b >= 0xE0) + (b >= 0xF0)
                self._low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self._high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append(whole.decode() + "�")
                whole.clear()
        out.append(whole.decode())
        return "".join(out)

    def finish(self) -> str:
        out = "�" if self._held else ""
        self.__init__()
        return out


class ByteBpe:
    """Encoder and decoder for whole texts; ``max_memo`` bounds the matches whose ids are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_memo: int = 1_000_000):
        self.transducer, self.split, self.max_memo = BpeTransducer(ranks), Splitter(pattern), max_memo
        self._memo: dict[str, bytes] = {}
        self._bytes = [self.transducer.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self._whole = np.array([_is_utf8(x) for x in self._bytes])

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces, memo = self.split(text), self._memo
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            pass
        if len(memo) > self.max_memo:
            memo.clear()
        encode = self.transducer.encode
        for piece in pieces:
            if piece not in memo:
                memo[piece] = np.array(encode(piece.encode()), "<u4").tobytes()
        return b"".join(map(memo.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes whole, token by token."""
        machine = Utf8Machine()
        for i in ids:
            if part := machine.feed(self._bytes[i]):
                yield part
        if rest := machine.finish():
            yield rest

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the decoded text (U+FFFD for ill-formed parts)."""
        of = self._bytes.__getitem__
        whole = self._whole[ids]
        if whole.all():
            return b"".join(map(of, ids.tolist()))
        machine, out, edges = Utf8Machine(), [], np.flatnonzero(np.diff(whole)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
            part = b"".join(map(of, ids[lo:hi].tolist()))
            if whole[lo] and not machine.pending:
                out.append(part)
            else:
                out.append(machine.feed(part).encode())
        out.append(machine.finish().encode())
        return b"".join(out)


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


_codecs: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """The codec of this Python process for a ranks file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_decode(documents: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids again, and return a row for each row of ``documents``.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (array of int).
    A null or empty text has no tokens and the hashes of no bytes; a null doc_id stays null; repeated
    rows are each encoded; other columns are not read. Map-only: no shuffle.
    """

    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in slices(batches):
            n, ids_sha, text_sha, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                packed = c.encode_packed(text)
                ids = np.frombuffer(packed, "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(c.decode_bytes(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return documents.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(run, schema)
