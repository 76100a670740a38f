"""Splitting texts into the pieces that byte-pair merges never cross, on flat code-point arrays."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

from . import flat

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The letters that make a piece of their own with an apostrophe before them.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of every code point by its Unicode category, and which ones this interpreter's tables do not know yet."""
    named = {"L": LETTER, "N": NUMBER}
    categories = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
    kind = np.fromiter((named.get(c[0], OTHER) for c in categories), np.uint8, len(categories))
    kind[_WHITE] = SPACE
    return kind, np.fromiter((c == "Cn" for c in categories), bool, len(categories))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offs


def _contractions(cp, kind, brk, offs):
    """Sets the piece that starts at an apostrophe to take the letters of a contraction with it."""
    at = np.flatnonzero((cp[:-1] == 39) & brk[:-1] & (kind[1:] == LETTER) & ~brk_at(offs, len(cp))[1:])
    if not len(at):
        return
    for letters in CONTRACTIONS:
        codes = [ord(c) for c in letters]
        ok = at[at + len(codes) < len(cp)]
        if len(codes) == 2:
            ok = ok[~brk_at(offs, len(cp))[ok + 2]]
        for k, c in enumerate(codes):
            ok = ok[cp[ok + 1 + k] == c]
        brk[ok + 1] = False
        after = ok + 1 + len(codes)
        brk[after[after < len(cp)]] = True


def brk_at(offs: np.ndarray, n: int) -> np.ndarray:
    flag = np.zeros(n, bool)
    at = offs[:-1]
    flag[at[at < n]] = True
    return flag


def pieces(cp: np.ndarray, offs: np.ndarray, mode: str, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the pieces; kind: that of each code point, where the tokenizer has its own.

    mode "word": letter runs, single numbers, runs of other characters; white space is dropped.
    mode "byte": letter, number and other runs with one space before them, and the white space left.
    mode "spaced": cut before each space that follows something else.
    """
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = brk_at(offs, n)
    brk = first.copy()
    if mode == "spaced":
        brk[1:] |= (cp[1:] == 32) & (cp[:-1] != 32)
        starts = np.flatnonzero(brk)
        return starts, np.append(starts[1:], n), np.searchsorted(offs, starts, "right") - 1
    kind = kinds()[0][cp] if kind is None else kind
    brk[1:] |= kind[1:] != kind[:-1]
    if mode == "word":
        brk |= kind == NUMBER
        _contractions(cp, kind, brk, offs)
    else:
        heads = np.flatnonzero(brk & (kind != SPACE) & ~first)
        heads = heads[kind[heads - 1] == SPACE]
        spaced = heads[cp[heads - 1] == 32]
        free = brk.copy()
        free[spaced] = False
        _contractions(cp, kind, free, offs)
        brk = free
        brk[heads - 1] = True
    starts = np.flatnonzero(brk)
    ends = np.append(starts[1:], n)
    if mode == "word":
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


_U = np.uint64


def piece_hash(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, _ = flat.powers(len(cp) + 1)
    prefix = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(flat.mix(cp.astype(np.uint64) + _U(1)) * p[: len(cp)], out=prefix[1:])
    return flat.span_hash(prefix, starts, ends)


class PieceCache:
    """Ids of pieces; encode(bytes, lengths) -> (ids, lengths) runs once for each new piece.

    Pieces are found by a hash and then compared, code point by code point, with the piece remembered under it: one that
    only shares its hash is encoded by itself. The cache forgets all once it holds `most` pieces or 8 * most code
    points, so its memory is bounded; results never depend on it.
    """

    def __init__(self, mode: str, encode, most: int = 400_000, ask=None):
        """ask: kinds of code points that the interpreter does not know, from the tokenizer itself; each is asked for once."""
        self.mode, self.encode, self.most, self.ask = mode, encode, most, ask
        if ask:
            self.kind, self.unsure = (a.copy() for a in kinds())
        self._clear()

    def _kind(self, cp: np.ndarray) -> np.ndarray | None:
        if not self.ask:
            return None
        if (odd := self.unsure[cp]).any():
            new = np.unique(cp[odd])
            self.kind[new], self.unsure[new] = self.ask(new.tolist()), False
        return self.kind[cp]

    def _clear(self):
        none = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, np.uint64)
        self.at = self.len = self.begin = self.end = none
        self.pool, self.spelled = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _encoded(self, chosen: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces given as their code points end to end."""
        wide = 1 + (chosen >= 0x80).astype(np.int64) + (chosen >= 0x800) + (chosen >= 0x10000)
        heads = np.cumsum(lengths) - lengths
        raw = np.frombuffer(chosen.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        return self.encode(raw, np.add.reduceat(wide, heads))

    def _learn(self, hashes: np.ndarray, chosen: np.ndarray, lengths: np.ndarray) -> None:
        got, got_len = self._encoded(chosen, lengths)
        order = np.searchsorted(self.hashes, hashes)
        ends = len(self.spelled) + np.cumsum(lengths)
        self.at = np.insert(self.at, order, len(self.pool) + np.cumsum(got_len) - got_len)
        self.len = np.insert(self.len, order, got_len)
        self.begin, self.end = np.insert(self.begin, order, ends - lengths), np.insert(self.end, order, ends)
        self.hashes = np.insert(self.hashes, order, hashes)
        self.pool, self.spelled = np.concatenate((self.pool, got)), np.concatenate((self.spelled, chosen))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        cp, offs = code_points(texts)
        starts, ends, doc = pieces(cp, offs, self.mode, self._kind(cp))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        uniq, index, inverse = np.unique(piece_hash(cp, starts, ends), return_index=True, return_inverse=True)
        slot = np.searchsorted(self.hashes, uniq)
        known = np.zeros(len(uniq), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(slot, len(self.hashes) - 1)] == uniq
        if not known.all():
            fresh = np.flatnonzero(~known)
            s = starts[index[fresh]]
            n = ends[index[fresh]] - s
            if len(self.hashes) and (len(self.hashes) + len(fresh) > self.most or len(self.spelled) + int(n.sum()) > 8 * self.most):
                self._clear()
                # what this call needs of the forgotten ones is encoded again
                return self.ids(texts)
            self._learn(uniq[fresh], cp[flat.ragged(s, n)], n)
            slot = np.searchsorted(self.hashes, uniq)
        slot = slot[inverse]
        at, lengths, pool = self.at[slot], self.len[slot], self.pool
        odd = np.flatnonzero(~flat.equal_spans(cp, starts, ends, self.spelled, self.begin[slot], self.end[slot]))
        if len(odd):
            n = ends[odd] - starts[odd]
            got, got_len = self._encoded(cp[flat.ragged(starts[odd], n)], n)
            at[odd], lengths[odd] = len(pool) + np.cumsum(got_len) - got_len, got_len
            pool = np.concatenate((pool, got))
        ids = pool[flat.ragged(at, lengths)]
        return ids, np.bincount(doc, weights=lengths, minlength=len(texts)).astype(np.int64)
