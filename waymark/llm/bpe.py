"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse as a byte-to-text state machine.

Every text is fed in chunks, whatever its length, and tokens are emitted once no later character can change them; what is
held is a chunk and a tail. Two levels decide:

* Pre-tokens: a piece that ends LOOK characters or more before the end of what is held is final, as the pattern looks at
  most two characters ahead; the length of a special token is added, as one may have begun. A final piece is merged by the
  file's merge list (kept for pieces that come again; those that look new in a batch of texts are merged beforehand, in step).
* Within a piece that outgrows a chunk: the merge list's sufficient lookahead. Each prefix of a text has one last token,
  and a token is it if it goes with the last token of the prefix before it, which is decided by the merges of the two
  alone. So prefixes form a tree by their last tokens. No token is longer than `lookahead` bytes (computed from the
  vocabulary): every longer text has a token boundary among the last `lookahead` places, so what their paths in the tree
  share is stable and is emitted.

Decoding maps each id to its bytes and runs an incremental UTF-8 decoder, which holds at most three bytes.

Defined results: null text is empty and has no tokens; the special token's string in a text is the special token, as in
the library; rows that repeat are encoded each; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.common import add_columns

#: Characters fed at once; pieces kept with their ids, and the longest kept in bytes.
CHUNK, KEPT, KEPT_BYTES = 1 << 14, 1 << 17, 64
#: Of each text of a batch so many characters are looked through for pieces to merge together: at most so many bytes each, so many
#: at once.
AHEAD, AHEAD_BYTES, ROWS = 1 << 18, 32, 8192
#: Characters after a piece that make it final.
LOOK = 3
# The byte-level pre-tokenizer's pattern, and a character that each kind of piece goes on after.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
KINDS = ((regex.compile(r"\p{L}"), "a"), (regex.compile(r"\p{N}"), "0"), (regex.compile(r"\s"), "\n"), (regex.compile(r"."), "!"))
#: Most pieces, or strings that are none, which costs their merge and no more: kept pieces are only ever looked up.
LETTERS = re.compile(r" ?[^\W\d_]+")
_NONE = 1 << 62


def byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """The merge list of a tokenizer file: tokens of whole pieces, and whether two tokens go together."""

    def __init__(self, spec: dict):
        chars, vocab = byte_chars(), spec["model"]["vocab"]
        self.bytes_of = [b""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for w, i in vocab.items():
            self.bytes_of[i] = bytes(chars[c] for c in w)
        self.byte_id = [0] * 256
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        self.shift = len(self.bytes_of).bit_length()
        #: (left, right) as a number -> rank and merged id as a number
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << self.shift | vocab[b]] = rank << self.shift | vocab[a + b]
        #: The same as arrays, by the pair.
        self.of_byte, self.keys = np.array(self.byte_id), np.array(sorted(self.ranks), np.int64)
        self.values = np.array([self.ranks[k] for k in self.keys.tolist()], np.int64)
        for a in spec["added_tokens"]:
            self.bytes_of[a["id"]] = a["content"].encode()
        #: No token of the vocabulary has more bytes.
        self.lookahead = max(len(self.bytes_of[i]) for i in vocab.values())
        #: Tokens by their bytes from the last to the first; the key None holds the id.
        self.ends: dict = {}
        for w, i in vocab.items():
            at = self.ends
            for b in reversed(self.bytes_of[i]):
                at = at.setdefault(b, {})
            at[None] = i
        self.fits: dict[int, bool] = {}

    def whole(self, raw: bytes) -> list[int]:
        """The tokens of a short piece: the merge of the lowest rank, the leftmost of equals, until there is none."""
        ids, shift = [self.byte_id[b] for b in raw], self.shift
        known, mask = self.ranks.get, (1 << shift) - 1
        found = [known(a << shift | b, _NONE) for a, b in zip(ids, ids[1:])]
        while found and (least := min(found)) != _NONE:
            k = found.index(least)
            ids[k : k + 2] = [least & mask]
            del found[k]
            if k:
                found[k - 1] = known(ids[k - 1] << shift | ids[k], _NONE)
            if k < len(found):
                found[k] = known(ids[k] << shift | ids[k + 1], _NONE)
        return ids

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """ranks of pairs; -1 on the right: none."""
        at = np.minimum(np.searchsorted(self.keys, key := left << self.shift | right), len(self.keys) - 1)
        return np.where((right >= 0) & (self.keys[at] == key), self.values[at], _NONE)

    def many(self, raws: list[bytes]) -> list[bytes]:
        """packed(whole()) of each short piece: a row each, all merged in step."""
        if not raws or not len(self.keys):
            return [packed(self.whole(r)) for r in raws]
        out, order = [b""] * len(raws), np.argsort(np.array([len(r) for r in raws]), kind="stable")
        for low in range(0, len(raws), ROWS):
            own = order[low : low + ROWS]
            n = np.array([len(raws[k]) for k in own])
            wide = max(2, int(n[-1]))
            ids = self.of_byte[np.frombuffer(b"".join([raws[k].ljust(wide, b"\0") for k in own]), np.uint8).reshape(-1, wide)]
            ids[np.arange(wide) >= n[:, None]] = -1
            found = self._pairs(ids[:, :-1], ids[:, 1:])
            while len(own):
                if (wide := ids.shape[1]) > 1:
                    k = found.argmin(1)
                    least = found[np.arange(len(own)), k]
                    go = least < _NONE
                else:
                    go = np.zeros(len(own), bool)
                done = ids[~go].astype("<u4").tobytes()
                for i, (row, count) in enumerate(zip(own[~go].tolist(), n[~go].tolist())):
                    out[row] = done[4 * i * wide : 4 * (i * wide + count)]
                own, n = own[go], n[go] - 1
                if not len(own):
                    break
                ids, found, k, least, rows = ids[go], found[go], k[go], least[go], np.arange(len(own))
                later = np.arange(wide - 1) > k[:, None]
                ids = np.where(later, ids[:, 1:], ids[:, :-1])
                ids[rows, k] = least & (1 << self.shift) - 1
                found = np.where(later[:, :-1] | (np.arange(wide - 2) == k[:, None]), found[:, 1:], found[:, :-1])
                for here in (k - 1, k):
                    at = (here >= 0) & (here < wide - 2)
                    r, c = rows[at], here[at]
                    found[r, c] = self._pairs(ids[r, c], ids[r, c + 1])
        return out

    def fit(self, left: int, right: int) -> bool:
        """Whether the tokens are what their bytes together are merged to."""
        key = left << self.shift | right
        if key not in self.fits:
            if len(self.fits) >= KEPT:
                self.fits.clear()
            self.fits[key] = self.whole(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return self.fits[key]


class Piece:
    """A piece of any length, byte by byte; holds what is not stable yet."""

    STEP = 2048

    def __init__(self, merges: Merges):
        self.m, self.data, self.last = merges, bytearray(), -1
        #: For each length of a prefix of data: its last token, and where that begins.
        self.token, self.begin = [-1], [0]

    def _grow(self, raw: bytes) -> None:
        data, token, begin, fit = self.data, self.token, self.begin, self.m.fit
        for b in raw:
            data.append(b)
            at, q = self.m.ends, len(data)
            while q and (at := at.get(data[q - 1])):
                q -= 1
                i = at.get(None)
                if i is not None:
                    before = token[q] if q else self.last
                    if fit(before, i) if before >= 0 else self.m.whole(self.m.bytes_of[i]) == [i]:
                        token.append(i)
                        begin.append(q)
                        break
            else:
                raise ValueError("no token ends here")

    def _path(self, end: int) -> list[int]:
        ids = []
        while end:
            ids.append(self.token[end])
            end = self.begin[end]
        return ids[::-1]

    def feed(self, raw: bytes) -> list[int]:
        """The tokens that became stable."""
        out: list[int] = []
        for k in range(0, len(raw), self.STEP):
            self._grow(raw[k : k + self.STEP])
            n = len(self.data)
            ends = set(range(max(0, n - self.m.lookahead + 1), n + 1))
            while len(ends) > 1:
                far = max(ends)
                ends.remove(far)
                ends.add(self.begin[far])
            stable = ends.pop()
            if stable:
                out += self._path(stable)
                self.last = out[-1]
                del self.data[:stable]
                self.token = [-1, *self.token[stable + 1 :]]
                self.begin = [0, *(x - stable for x in self.begin[stable + 1 :])]
        return out

    def end(self) -> list[int]:
        return self._path(len(self.data))


class _Kept(dict):
    """Ids of pieces, as bytes."""

    def __init__(self, merges: Merges):
        self.m = merges

    def learn(self, texts: list[str]) -> None:
        """Most pieces of a batch of texts, merged together."""
        found = set()
        for x in texts:
            found.update(LETTERS.findall(x[:AHEAD]))
        new = found - self.keys()
        if len(self) + len(new) > KEPT:
            self.clear()
            new = found
        raws = {p: raw for p in new if len(raw := p.encode()) <= AHEAD_BYTES}
        self.update(zip(raws, self.m.many(list(raws.values()))))

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        if len(raw) > KEPT_BYTES:
            long = Piece(self.m)
            return packed(long.feed(raw) + long.end())
        if len(self) >= KEPT:
            self.clear()
        ids = self[piece] = packed(self.m.whole(raw))
        return ids


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Stream:
    """One text: feed() gives the ids that became final, end() the rest; ids are little-endian 32-bit numbers."""

    def __init__(self, t: Transducer):
        self.t, self.held, self.lead, self.long = t, "", "", None

    def _emit(self, pieces: list[str]) -> bytes:
        """Of final pieces; the first may end a long one."""
        if not pieces:
            return b""
        done = b""
        if self.long is not None:
            done = packed(self.long.feed(pieces[0][1:].encode()) + self.long.end())
            self.lead, self.long, pieces = "", None, pieces[1:]
        return done + b"".join([self.t.kept[p] for p in pieces])

    def _close(self, text: str) -> bytes:
        """All of a text that nothing follows, or a special token."""
        return self._emit(PIECE.findall(self.lead + text))

    def feed(self, chunk: str) -> bytes:
        held, out = self.held + chunk, []
        if self.t.special:
            while found := self.t.special.search(held):
                out += [self._close(held[: found.start()]), packed([self.t.special_id[found[0]]])]
                held = held[found.end() :]
        pieces, open_ = PIECE.findall(self.lead + held), 0
        while pieces and open_ < self.t.look:
            open_ += len(pieces.pop())
        if pieces:
            out.append(self._emit(pieces))
            held = held[len(held) - open_ :]
        elif len(held) > self.t.chunk:
            # One piece covers all but the tail: what of it is sure goes on byte by byte.
            sure, held = held[: len(held) - self.t.look], held[len(held) - self.t.look :]
            if self.long is None:
                self.long, self.lead = Piece(self.t.merges), next(c for kind, c in KINDS if kind.match(sure[1]) or c == "!")
            out.append(packed(self.long.feed(sure.encode())))
        self.held = held
        return b"".join(out)

    def end(self) -> bytes:
        out, self.held = self._close(self.held), ""
        return out


class Transducer:
    """Encoder and decoder of one tokenizer file (byte-level BPE)."""

    def __init__(self, path: str, chunk: int = CHUNK):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges, self.chunk = Merges(spec), chunk
        self.kept = _Kept(self.merges)
        self.special_id = {a["content"]: a["id"] for a in spec["added_tokens"]}
        longest = max(map(len, self.special_id), default=1)
        self.special = re.compile("|".join(map(re.escape, sorted(self.special_id, key=len, reverse=True)))) if self.special_id else None
        self.look = LOOK + longest - 1

    def encode(self, chunks: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids, as they become final, of the text that the chunks make up."""
        stream = Stream(self)
        for chunk in chunks:
            for at in range(0, len(chunk), self.chunk):
                if ids := stream.feed(chunk[at : at + self.chunk]):
                    yield np.frombuffer(ids, "<u4")
        if ids := stream.end():
            yield np.frombuffer(ids, "<u4")

    def decode(self, ids: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text, as it becomes known, of ids that come in lists."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        table = self.merges.bytes_of.__getitem__
        for part in ids:
            part = part.tolist() if isinstance(part, np.ndarray) else part
            yield state.decode(b"".join(map(table, part)))
        yield state.decode(b"", True)


_made: dict[tuple[str, int], Transducer] = {}


def transducer(path: str, chunk: int = CHUNK) -> Transducer:
    """One per worker process."""
    if (path, chunk) not in _made:
        _made[path, chunk] = Transducer(path, chunk)
    return _made[path, chunk]


def _joined(lists: Iterable[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int32), *(part.astype(np.int32) for part in lists)])


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with ids, an array of int."""

    def make():
        t = transducer(tokenizer, chunk)
        def values(texts):
            t.kept.learn(list(filter(None, texts)))
            return [[_joined(t.encode([x or ""])) for x in texts]]

        return values

    return add_columns(docs, text_col, [("ids", T.ArrayType(T.IntegerType()))], make)


def _decoded_sha256(t: Transducer, ids: Iterable[Iterable[int]]) -> str:
    h = hashlib.sha256()
    for piece in t.decode(ids):
        h.update(piece.encode())
    return h.hexdigest()


def encode_checked(docs: DataFrame, tokenizer: str, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with ids and decoded_sha256, the digest of what the ids decode to: one pass, one set of Python workers."""

    def make():
        t = transducer(tokenizer, chunk)

        def values(texts):
            t.kept.learn(list(filter(None, texts)))
            ids = [_joined(t.encode([x or ""])) for x in texts]
            return [ids, [_decoded_sha256(t, (x[k : k + chunk] for k in range(0, len(x), chunk))) for x in ids]]

        return values

    return add_columns(docs, text_col, [("ids", T.ArrayType(T.IntegerType())), ("decoded_sha256", T.StringType())], make)


def decode(docs: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """docs with decoded, the text of the ids; a null list is empty."""

    def make():
        t = transducer(tokenizer)
        return lambda lists: [["".join(t.decode([x or []])) for x in lists]]

    return add_columns(docs, ids_col, [("decoded", T.StringType())], make)


def round_trip(docs: DataFrame, tokenizer: str, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256: the encoder's stream goes through the decoder, neither is kept whole."""

    def make():
        t = transducer(tokenizer, chunk)

        def one(text: str) -> tuple[int, str, str]:
            count, h = 0, hashlib.sha256()

            def passed():
                nonlocal count
                for part in t.encode([text]):
                    count += len(part)
                    h.update(part.tobytes())
                    yield part

            decoded = _decoded_sha256(t, passed())
            return count, h.hexdigest(), decoded

        def values(texts):
            t.kept.learn(list(filter(None, texts)))
            return [list(c) for c in zip(*(one(x or "") for x in texts))] if texts else [[], [], []]

        return values

    return add_columns(docs, text_col, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], make)
