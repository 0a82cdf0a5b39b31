"""Byte-level BPE without regular expressions: vectorised pre-tokenisation, cached pair merging, decoding.

Texts become arrays of code-point classes. Each class is a function on the states of a small
automaton, and functions compose associatively: blocks of a chunk are composed all at once, a scan
over the blocks gives the state in which each begins, and a last sweep gives the state before every
code point. State and class say where a piece begins. Pieces are slices of the text's bytes (their
offsets stay known); equal pieces are merged once and kept in a bounded cache, and all new pieces of
a chunk are merged side by side, each by its leftmost lowest-ranked pair.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import span_hashes, text_chunks, utf8

# Classes of code points. _FIRST is added for the first code point of a text.
_L, _N, _O, _SP, _WS, _AP, _STMD, _R, _V, _LL, _E = range(11)
_FIRST = 11
_CLASSES = 22
# States: what the code point before was, as far as it matters.
_FRESH, _IN_L, _IN_N, _IN_O, _AT_SP, _AT_WS, _AT_AP, _AP_R, _AP_V, _AP_L = range(10)
_STATES = 10
_LETTERS = (_L, _STMD, _R, _V, _LL, _E)
#: The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points in a block of the scan, and those that are scanned at once.
BLOCK, STRETCH = 256, 1 << 20


def _step(state: int, kind: int) -> tuple[int, bool, bool]:
    """The next state, whether a piece begins at this code point, and whether the one before does not
    begin a piece after all (the end of a contraction of three)."""
    if kind >= _FIRST:
        return _step(_FRESH, kind - _FIRST)[0], True, False
    if kind in (_SP, _WS):
        return (_AT_SP if kind == _SP else _AT_WS), state not in (_AT_SP, _AT_WS), False
    joined = state == _AT_SP
    if kind == _N:
        return _IN_N, state != _IN_N and not joined, False
    if kind in (_O, _AP):
        run = state in (_IN_O, _AT_AP)
        alone = kind == _AP and not run and not joined
        return (_AT_AP if alone else _IN_O), not run and not joined, False
    if state == _AT_AP:
        if kind == _STMD:
            return _FRESH, False, False
        return {_R: _AP_R, _V: _AP_V, _LL: _AP_L}.get(kind, _IN_L), True, False
    if (state in (_AP_R, _AP_V) and kind == _E) or (state == _AP_L and kind == _LL):
        return _FRESH, False, True
    return _IN_L, state not in (_IN_L, _AP_R, _AP_V, _AP_L) and not joined, False


_TABLE = [[_step(s, k) for s in range(_STATES)] for k in range(_CLASSES)]
_NEXT = np.array([[x[0] for x in row] for row in _TABLE], np.uint8).ravel()
_BEGINS = np.array([[x[1] for x in row] for row in _TABLE], bool).ravel()
_UNDOES = np.array([[x[2] for x in row] for row in _TABLE], bool).ravel()


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(0x110000, _O, np.uint8)
    category = np.frombuffer("".join([unicodedata.category(chr(c))[0] for c in range(0x110000)]).encode(), np.uint8)
    kinds[category == ord("L")] = _L
    kinds[category == ord("N")] = _N
    kinds[WHITE_SPACE] = _WS
    kinds[0x20] = _SP
    kinds[ord("'")] = _AP
    for chars, kind in (("stmd", _STMD), ("r", _R), ("v", _V), ("l", _LL), ("e", _E)):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


def states_before(kinds: np.ndarray, begin: int = _FRESH) -> np.ndarray:
    """The automaton's state before each code point, by an associative scan of transition functions.

    ``begin`` is the state before the first of them.
    """
    n = len(kinds)
    blocks = max(1, -(-n // BLOCK))
    padded = np.full(blocks * BLOCK, _SP, np.int64)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) * _STATES
    # After white space every state is the same, so a block with some is a constant function, known
    # from one state; only blocks without any are composed for all states.
    kind = padded.reshape(blocks, BLOCK) % _FIRST
    open_ = np.flatnonzero(~((kind == _SP) | (kind == _WS)).any(1))
    one, many = np.zeros(blocks, np.uint8), np.tile(np.arange(_STATES, dtype=np.uint8), (len(open_), 1))
    for column in columns:
        one = _NEXT[column + one]
        if len(open_):
            many = _NEXT[column[open_, None] + many]
    whole = np.repeat(one[:, None], _STATES, 1)
    whole[open_] = many
    # Inclusive scan by doubling: whole[b] becomes the function of blocks 0..b.
    step = 1
    while step < blocks:
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.int64), 1)
        step *= 2
    state = np.concatenate([[begin], whole[:-1, begin]]).astype(np.uint8)
    before = np.empty((BLOCK, blocks), np.uint8)
    for j, column in enumerate(columns):
        before[j] = state
        state = _NEXT[column + state]
    return before.T.ravel()[:n]


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Indexes of code points at which a piece begins; ``firsts`` has each text's first code point."""
    kinds = code_point_classes()[points]
    blank = (kinds == _SP) | (kinds == _WS)
    ends = np.zeros(len(points), bool)
    ends[firsts[firsts > 0] - 1] = True
    kinds[firsts] += _FIRST
    begins, state = np.empty(len(points), bool), _FRESH
    for i in range(0, len(points), STRETCH):
        here = kinds[i : i + STRETCH]
        at = here.astype(np.int64) * _STATES + states_before(here, state)
        begins[i : i + STRETCH] = _BEGINS[at]
        begins[np.flatnonzero(_UNDOES[at]) + (i - 1)] = False
        state = int(_NEXT[at[-1]])
    # The last white space before something else goes with it, or stands alone.
    begins[:-1] |= blank[:-1] & ~blank[1:] & ~ends[:-1]
    return np.flatnonzero(begins)


@dataclass
class Vocabulary:
    """Bytes of each id, and the pairs that may be merged: sorted keys, priorities and merged ids."""

    tokens: list[bytes]
    keys: np.ndarray
    priority: np.ndarray
    merged: np.ndarray
    whole: dict[bytes, int]

    @classmethod
    def _of(cls, tokens: dict[int, bytes], pairs: dict[tuple[int, int], tuple[int, int]], whole: dict[bytes, int]) -> Vocabulary:
        table = sorted((a << 32 | b, p, m) for (a, b), (p, m) in pairs.items())
        columns = np.array(table, np.int64).reshape(-1, 3)
        return cls([tokens.get(i, b"") for i in range(max(tokens) + 1)], columns[:, 0].copy(), columns[:, 1].copy(), columns[:, 2].copy(), whole)

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A file of ranks: any two neighbours whose bytes together have a rank may merge, and a piece
        that has a rank itself is one token."""
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left, right] = rank, rank
        return cls._of({r: t for t, r in ranks.items()}, pairs, ranks)

    @classmethod
    def from_merges(cls, path: str) -> Vocabulary:
        """A tokenizer file with a list of merges over bytes written as printable characters."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        back = {c: b for b, c in _printable().items()}
        tokens = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items() if all(c in back for c in t)}
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.setdefault((model["vocab"][a], model["vocab"][b]), (rank, model["vocab"][a + b]))
        single = {tokens[i]: i for i in tokens if len(tokens[i]) == 1}
        # The special token is the last of the file; nothing encodes to it.
        return cls._of(tokens, pairs, single)


def _printable() -> dict[int, str]:
    """The character that stands for each byte in such files: itself where printable, else one from 256 on."""
    # The ranges of printable bytes that the format prescribes.
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, by its ending."""
    return Vocabulary.from_merges(path) if path.endswith(".json") else Vocabulary.from_ranks(path)


def _alike(buf: np.ndarray, starts: np.ndarray, size: np.ndarray, some: np.ndarray, like: np.ndarray) -> bool:
    """Whether the pieces ``some`` have the bytes of the pieces ``like``, of the same sizes."""
    away = np.repeat(starts[like] - starts[some], size[some])
    inside = np.repeat(starts[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(len(away))
    return bool((buf[inside] == buf[inside + away]).all())


def _distinct(buf: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each piece's kind, and of each kind one piece: pieces of a kind have equal bytes.

    ``starts`` and ``ends`` divide all of ``buf``. Kinds are found by hashes, then every byte is compared.
    """
    codes, kinds = pd.factorize(span_hashes(buf, starts, ends))
    example = np.empty(len(kinds), np.int64)
    example[codes[::-1]] = np.arange(len(codes))[::-1]
    like = example[codes]
    size = ends - starts
    if (size == size[like]).all() and all(_alike(buf, starts, size, moved, like[moved]) for moved in np.array_split(np.flatnonzero(like != np.arange(len(like))), 1 + len(like) // 200_000)):
        return codes, example
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    example = np.empty(len(known), np.int64)
    example[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, example


_NEVER = np.int64(1 << 60)
#: Pieces from this many bytes on are merged one by one with a heap.
LONG_PIECE = 400


class Encoder:
    """Encodes texts of one vocabulary; keeps at most ``cache`` pieces of up to LONG_PIECE bytes.

    Pieces are told apart by their bytes; hashes only find those that are likely equal.
    """

    def __init__(self, vocab: Vocabulary, cache: int = 400_000) -> None:
        self.vocab, self.cache = vocab, cache
        self.bytes_to_id = np.array([vocab.whole[bytes([b])] for b in range(256)], np.int64)
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = self.count = 0
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.vocab
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        hit = v.keys[at] == key
        return np.where(hit, v.priority[at], _NEVER), v.merged[at]

    def _merge_long(self, piece: bytes) -> list[int]:
        """Pair merging with a heap and a linked list, for one long piece."""
        ids = self.bytes_to_id[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        priority, merged = self._lookup(ids[:-1], ids[1:])
        heap = [(int(p), i, int(ids[i]), int(ids[i + 1]), int(m)) for i, (p, m) in enumerate(zip(priority, merged, strict=True)) if p < _NEVER]
        heapq.heapify(heap)
        tokens, before, after = ids.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = m, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    p, mm = self._lookup(np.array([tokens[x]]), np.array([tokens[y]]))
                    if p[0] < _NEVER:
                        heapq.heappush(heap, (int(p[0]), x, tokens[x], tokens[y], int(mm[0])))
        return [t for t in tokens if t >= 0]

    def _merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and the number of each piece's, by rounds of one merge in each."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        tok = self.bytes_to_id[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(n), sizes)
        done_tok, done_owner = [], []

        def ranks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the pairs that begin at these places."""
            after = np.minimum(at + 1, len(tok) - 1)
            p, m = self._lookup(tok[at], tok[after])
            return np.where((at + 1 < len(tok)) & (owner[at] == owner[after]), p, _NEVER), m

        if len(tok):
            rank, into = ranks(np.arange(len(tok)))
        while len(tok):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(tok)))
            alive = np.repeat(least < _NEVER, span)
            if not alive.all():
                done_tok.append(tok[~alive])
                done_owner.append(owner[~alive])
                tok, owner, rank, into = tok[alive], owner[alive], rank[alive], into[alive]
                least, span = least[least < _NEVER], span[least < _NEVER]
                if not len(tok):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, span))
            at = hits[np.flatnonzero(np.diff(owner[hits], prepend=-1))]
            tok[at] = into[at]
            keep = np.ones(len(tok), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            tok, owner, rank, into = tok[keep], owner[keep], rank[keep], into[keep]
            for place in (moved, moved[moved > 0] - 1):
                rank[place], into[place] = ranks(place)
        if not done_tok:
            return np.zeros(0, np.int32), sizes
        toks, owners = np.concatenate(done_tok), np.concatenate(done_owner)
        order = np.argsort(owners, kind="stable")
        return toks[order].astype(np.int32), np.bincount(owners, minlength=n)

    def _add(self, pieces: list[bytes]) -> None:
        """Merge new pieces and give them slots; those of LONG_PIECE bytes and more are not found again."""
        none = repeat(-1)
        whole = np.fromiter(map(self.vocab.whole.get, pieces, none), np.int64, len(pieces))
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        short = np.flatnonzero((whole < 0) & (length < LONG_PIECE))
        ids, sizes = self._merge_all([pieces[i] for i in short.tolist()])
        long = {i: self._merge_long(pieces[i]) for i in np.flatnonzero((whole < 0) & (length >= LONG_PIECE)).tolist()}
        lengths = np.ones(len(pieces), np.int64)
        lengths[short] = sizes
        for i, x in long.items():
            lengths[i] = len(x)
        begin = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.int32)
        flat[begin[whole >= 0]] = whole[whole >= 0]
        flat[np.repeat(begin[short] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
        for i, x in long.items():
            flat[begin[i] : begin[i] + len(x)] = x
        n = self.count
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(pieces) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[n : n + len(pieces)] = self.used + begin
        self.size[n : n + len(pieces)] = lengths
        self.used += len(flat)
        self.count += len(pieces)
        self.slots.update((piece, n + i) for i, piece in enumerate(pieces) if len(piece) < LONG_PIECE)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets at which each text's ids begin (one more than texts)."""
        buf, offsets = utf8(texts)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        heads = np.flatnonzero((buf & 0xC0) != 0x80)  # the first byte of each code point
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.unique(offsets[:-1][np.diff(offsets) > 0])
        starts = heads[piece_starts(points, np.searchsorted(heads, begins))]
        ends = np.append(starts[1:], len(buf))
        raw = buf.tobytes()
        codes, example = _distinct(buf, raw, starts, ends)
        if self.count + len(example) > self.cache or self.used > 16 * self.cache:
            self._clear()
        distinct = [raw[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
        found = np.fromiter(map(self.slots.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        if len(new):
            before = self.count
            self._add([distinct[i] for i in new.tolist()])
            found[new] = before + np.arange(len(new))
        slot = found[codes]
        size = self.size[slot]
        total = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[slot] - (total - size), size) + np.arange(total[-1])]
        return ids, np.concatenate([[0], total])[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(vocabulary(path))
    return _ENCODERS[path]


def decode(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    """The bytes that the ids stand for."""
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def encode_decode(docs: DataFrame, path: str, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode it again, and add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the decoded bytes, both
    in lower-case hex; ``with_ids`` adds the ids themselves. Null texts count as empty ones (0 tokens).
    Repeated rows give repeated rows, an empty table an empty one. Other columns pass through; columns of
    the names above are replaced. A worker holds a text's bytes, ids and about 40 bytes for each piece.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in names]
    types = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>"] if with_ids else [])]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + types)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        tokens = coder.vocab.tokens
        decimals = [str(i).encode() for i in range(len(tokens))]
        for batch in batches:
            for part, texts in text_chunks(batch):
                ids, at = coder.encode(texts)
                hashes, decoded = [], []
                for i in range(len(texts)):
                    own = ids[at[i] : at[i + 1]].tolist()
                    hashes.append(hashlib.sha256(b",".join(map(decimals.__getitem__, own))).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(tokens.__getitem__, own))).hexdigest())
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                more = [pa.array(np.diff(at)), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    more.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays([*cols, *more], [*keep, *names])

    return source.mapInArrow(run, schema)


def token_crc32(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
