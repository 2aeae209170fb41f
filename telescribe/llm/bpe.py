"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece exactly one token can end its encoding. The vocabulary's automaton gives the tokens that end
at a position; the one that may follow the last token of the prefix before it is that position's last token. Following
these back from the end gives the ids that merging in rank order would give.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from telescribe.llm.common import map_rows

#: The byte-level pattern that cuts a text into pieces before merges.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PieceIds(dict):
    """Little-endian ids of the pieces met of late; when it holds too many, those not met since the last time are forgotten."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.before = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = np.asarray(self.encode(piece), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers file (model, merges and added tokens)."""

    def __init__(self, path: str, remember: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.alphabet = byte_alphabet()
        as_byte = {c: i for i, c in enumerate(self.alphabet)}
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = {}
        for r, (a, b) in enumerate(merges):
            self.made.setdefault(vocab[a + b], (r, vocab[a], vocab[b]))
        self.tails: dict[int, list[tuple[int, int]]] = {}
        self.heads: dict[int, list[tuple[int, int]]] = {}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.text = {t: bytes(as_byte[c] for c in s) for s, t in vocab.items() if s not in self.special}
        self.text |= {t: s.encode() for s, t in self.special.items()}
        self.automaton = ahocorasick.Automaton()
        for s, t in vocab.items():
            if s not in self.special and self._whole(t):
                self.automaton.add_word(s, (t, len(s)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces = regex.compile(PIECE)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = {b: c for b, c in enumerate(self.alphabet)}
        self.known = PieceIds(self.encode_piece, remember)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank of the merge that takes it up) from the outermost byte up to the token itself."""
        out, up = [], NEVER
        while True:
            out.append((token, up))
            if token not in self.made:
                return out[::-1]
            up, token = self.made[token][0], self.made[token][side]

    def _crossing(self, left: int, right: int) -> int:
        """The rank of the first merge across the border of two neighbouring tokens, NEVER if none comes.

        Merges run by rank, and for equal ranks from the left, so the border's merge comes before the right side's next
        one at the same rank but after the left side's.
        """
        a, b = self.tails.get(left), self.heads.get(right)
        if a is None:
            a = self.tails[left] = self._spine(left, 2)
        if b is None:
            b = self.heads[right] = self._spine(right, 1)
        i = j = 0
        while True:
            (x, x_up), (y, y_up) = a[i], b[j]
            across = self.rank.get(x << 32 | y, NEVER)
            if across < x_up and across <= y_up and across < NEVER:
                return across
            if x_up == y_up == NEVER:
                return NEVER
            if x_up <= y_up:
                i += 1
            else:
                j += 1

    def _whole(self, token: int) -> bool:
        """True if merging the token's own bytes gives the token."""
        if token not in self.made:
            return True
        r, left, right = self.made[token]
        return self._whole(left) and self._whole(right) and self._crossing(left, right) == r

    def follows(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 500_000:
                self.pairs.clear()
            known = self.pairs[key] = self._crossing(left, right) == NEVER
        return known

    def encode_piece(self, piece: str) -> list[int]:
        shown = piece.encode().decode("latin-1").translate(self.table)
        last = [-1] * (len(shown) + 1)
        size = [0] * (len(shown) + 1)
        pairs = self.pairs
        for end, (token, n) in self.automaton.iter(shown):
            before = end + 1 - n
            if before:
                p = last[before]
                if p < 0:
                    continue
                ok = pairs.get(p << 32 | token)
                if ok is None:
                    ok = self.follows(p, token)
                if not ok:
                    continue
            last[end + 1], size[end + 1] = token, n
        out, at = [], len(shown)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is read as an empty text."""
        if not text:
            return b""
        known = self.known.__getitem__
        if self.cut is None or self.cut.search(text) is None:
            return b"".join(map(known, self.pieces.findall(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(np.uint32(self.special[part]).astype("<u4").tobytes())
            else:
                out.extend(map(known, self.pieces.findall(part)))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary a process; the file is part of the installed environment of every executor."""
    return Bpe(path)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes the ids again, and returns both: (id, ids array<bigint>, decoded string).

    A null text is read as empty and gives no ids; null ids (of rows) stay; repeated rows give repeated rows; other
    columns are left out. An empty table gives an empty table.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def rows(cols):
        bpe = load(path)
        for key, text in zip(*cols):
            ids = bpe.encode(text)
            yield key, ids, bpe.decode(ids)

    return map_rows(df.select(id_col, text_col), rows, f"`{id_col}` {kind}, ids array<bigint>, decoded string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_decode() with digests in place of ids and text: (id, n_tokens, ids_sha256, decoded_sha256)."""
    kind = df.schema[id_col].dataType.simpleString()

    def rows(cols):
        bpe = load(path)
        for key, text in zip(*cols):
            packed = bpe.encode_bytes(text)
            decoded = bpe.decode(np.frombuffer(packed, dtype="<u4").tolist())
            yield key, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return map_rows(df.select(id_col, text_col), rows, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
