"""BPE encoding and decoding by batched merge rounds.

The symbols of many words lie in one flat array. Each neighbouring pair has a rank, found by binary
search over the sorted keys left * size + right; in each round every unfinished word merges all pairs
of its lowest rank (of overlapping ones the leftmost), all words at once, and only the pairs beside a
merge are looked up again. A word so takes no more rounds than it has unlike merges, however long it is.
This gives what merging the leftmost pair of lowest rank, one at a time, gives wherever no pair with the
merged symbol has a lower rank than the merge; at the few ranks where one has, a round merges the
leftmost pair of a word alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import flat
from .pretokens import LETTER, NUMBER, OTHER, SPACE, PieceCache, code_points, kinds
from .shared import col, map_columns

_NONE = np.int64(1) << np.int64(30)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class WordBPE:
    """A lower-casing BPE with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._set_steps(spec)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.size = np.int64(max(self.tokens) + 1)
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(pairs), dtype=np.int64)[order]
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.made = made  # by rank
        # the least rank of all pairs that hold a symbol; a merge is alone in its round where it makes a symbol of lower ranks
        least = np.full(int(self.size), _NONE, np.int64)
        for side in (self.keys // self.size, self.keys % self.size):
            np.minimum.at(least, side, self.ranks)
        self.alone = least[made] < np.arange(len(pairs))
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.decimal = [str(i) for i in range(int(self.size))]
        self.names = [self.tokens.get(i, "") for i in range(int(self.size))]
        self.cache = PieceCache("word", self.encode_words, ask=self._ask)

    def _set_steps(self, spec: dict) -> None:
        """The file's own normalizer and pre-tokenizer, for characters that they and the interpreter's tables see differently."""
        from tokenizers import Tokenizer

        steps = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.steps = steps.normalizer, steps.pre_tokenizer
        # marks whose class only one of them knows are sorted differently
        self.odd = kinds()[1].copy()
        overlay = chr(0x334)
        for c in np.flatnonzero(~self.odd).tolist():
            if unicodedata.combining(chr(c)) > 1:
                self.odd[c] = self.steps[0].normalize_str("a" + chr(c) + overlay) != self.normal("a" + chr(c) + overlay)

    def _ask(self, code: list[int]) -> list[int]:
        """Kinds of code points by how the file's pre-tokenizer cuts them from a letter and a sign."""
        out = []
        for c in map(chr, code):
            cuts = [len(self.steps[1].pre_tokenize_str(x)) for x in ("a" + c, "#" + c, c + c)]
            out.append(LETTER if cuts[0] == 1 and cuts[2] else OTHER if cuts[1] == 1 and cuts[2] else NUMBER if cuts[2] else SPACE)
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_words(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as their bytes end to end."""
        ends = np.cumsum(lengths)
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_sym, done_word = [], []
        rank = np.full(len(sym), _NONE, np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1]) if len(sym) else np.zeros(0, np.int64)
        rank[inside] = self.rank_of(sym[inside], sym[inside + 1])
        while len(sym):
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, heads)
            counts = np.diff(np.append(heads, len(sym)))
            open_ = best < _NONE
            if not open_.all():
                live = np.repeat(open_, counts)
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank = sym[live], word[live], rank[live]
                best, counts = best[open_], counts[open_]
            if not len(sym):
                break
            pos = self._merges(rank, best, counts)
            sym[pos] = self.made[rank[pos]]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            moved = pos - np.arange(len(pos))  # each earlier merge took one symbol away
            sym, word, rank = sym[keep], word[keep], rank[keep]
            touched = np.concatenate((moved, moved[moved > 0] - 1))
            last = np.append(word[1:] != word[:-1], True)[touched]
            rank[touched[last]] = _NONE
            touched = touched[~last]
            rank[touched] = self.rank_of(sym[touched], sym[touched + 1])
        all_sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        all_word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(all_word, kind="stable")
        return all_sym[order].astype(np.int32), np.bincount(all_word, minlength=len(lengths))

    def _merges(self, rank: np.ndarray, best: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Positions of the pairs that this round merges: of each word those of its lowest rank that do not overlap."""
        hits = np.flatnonzero(rank == np.repeat(best, counts))
        # pairs of equal symbols overlap in runs: of a run, every second one is merged
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:] != hits[:-1] + 1) | (rank[hits[1:]] != rank[hits[:-1]])
        run = np.flatnonzero(new)
        nth = np.arange(len(hits)) - run[np.cumsum(new) - 1]
        stay = nth % 2 == 0
        if self.alone[best].any():
            owner = np.searchsorted(np.cumsum(counts), hits, "right")
            first = np.ones(len(hits), bool)
            first[1:] = owner[1:] != owner[:-1]
            stay &= first | ~self.alone[best[owner]]
        return hits[stay]

    @staticmethod
    def normal(text: str) -> str:
        # lower-cased character by character: no form of sigma for word ends
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def normals(self, texts: list[str]) -> list[str]:
        """Normal forms; texts with characters that the interpreter sees differently go through the file's own normalizer."""
        cp, offs = code_points(texts)
        odd = np.unique(np.searchsorted(offs, np.flatnonzero(self.odd[cp]), "right") - 1)
        out = [self.normal(t) for t in texts]
        for k in odd.tolist():
            out[k] = self.steps[0].normalize_str(texts[k])
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text. Special tokens' strings become their ids."""
        parts, owner, fixed = [], [], []
        for k, t in enumerate(texts):
            for x in self.split.split(t) if self.split and "<|" in t else (t,):
                if x in self.special and "<|" in t:
                    fixed.append((len(parts), self.special[x]))
                    x = ""
                parts.append(x)
                owner.append(k)
        ids, counts = self.cache.ids(self.normals(parts))
        if fixed:
            at = np.concatenate(([0], np.cumsum(counts)))
            where = np.array([at[p] for p, _ in fixed])
            ids = np.insert(ids, where, np.array([i for _, i in fixed], np.int32))
            counts = counts.copy()
            counts[[p for p, _ in fixed]] = 1
        return ids, np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64) if owner else np.zeros(0, np.int64)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def _text_chunks(texts, limit: int = flat.CHUNK_BYTES):
    """Lists of Python strings of about `limit` bytes; null is empty."""
    _, offs = flat.flat_bytes(texts)
    for i, j in flat.chunks(offs, limit):
        yield i, [t or "" for t in texts.slice(i, j - i).to_pylist()]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array of token ids for each whole text; a null text has an empty array; a column of that name is replaced."""
    docs = docs.drop(ids)
    at = docs.columns.index(text)

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            for i, part in _text_chunks(b.column(at)):
                got, counts = bpe.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(got, pa.int32()))
                yield [*b.slice(i, len(part)).columns, lists]

    return map_columns(docs, run, [*docs.schema, StructField(ids, ArrayType(IntegerType()))])


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with the decoded string of each id array; a null array decodes to an empty string."""
    tokens = tokens.drop(text)
    at = tokens.columns.index(ids)

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = [bpe.decode(x or []) for x in b.column(at).slice(i, 512).to_pylist()]
                yield [*b.slice(i, 512).columns, pa.array(part, pa.string())]

    return map_columns(tokens, run, [*tokens.schema, StructField(text, StringType())])


def encode_decode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", others: tuple[str, ...] = (), keep_ids: bool = False) -> DataFrame:
    """doc_id, the other columns named, n_tokens, ids_sha256, decoded_sha256 (and ids): encodes and decodes in one pass over the texts.

    A row for each row of docs, repeated ones and null ids taken in; a null text is empty: no tokens, digests of the empty
    string. Others that have the name of a result are left out; columns not named are, too. An empty table stays empty.
    """
    from hashlib import sha256

    made = {doc_id, "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    docs = docs.select(col(text), col(doc_id), *(col(c) for c in others if c not in made))
    fields = docs.schema.fields[1:]

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            for i, part in _text_chunks(b.column(0)):
                got, counts = bpe.encode(part)
                at, a, d = 0, [], []
                for c in counts.tolist():
                    own = got[at : at + c].tolist()
                    at += c
                    a.append(sha256(" ".join(map(bpe.decimal.__getitem__, own)).encode()).hexdigest())
                    d.append(sha256(bpe.decode(own).encode("utf-8", "surrogatepass")).hexdigest())
                columns = [*(b.column(k + 1).slice(i, len(part)) for k in range(len(fields))), pa.array(counts), pa.array(a, pa.string()), pa.array(d, pa.string())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(got, pa.int32())))
                yield columns

    results = StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
    return map_columns(docs, run, [*fields, *results])
