"""Lists of patterns that run only over texts with a sign of them: words that a text needs for a pattern to match."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import let

_TOKEN = re.compile(r"\\.|\[(?:\\.|[^\]\\])+\]|\((?:\?(?:<?[=!]|:))?|\)|\{[^}]*\}|.", re.DOTALL)
#: Words of fewer characters are in most texts: patterns with such signs are tested apart, by sign.
LONG = 4


def _branches(tokens: list[str], at: int) -> tuple[list[frozenset], int]:
    """Signs of each alternative from `at` to the end of its group, and where that is."""
    out, needed, run = [], [], ""

    def close() -> str:
        if run:
            needed.append(frozenset([run]))
        return ""

    while at < len(tokens) and tokens[at] != ")":
        token = tokens[at]
        at += 1
        if token == "|":
            run = close()
            out.append(_best(needed))
            needed = []
            continue
        inner = None
        if token[0] == "(":
            run = close()
            inside, at = _branches(tokens, at)
            at += 1
            if token in ("(", "(?:") and all(inside):
                inner = frozenset().union(*inside)
        quantifier = tokens[at] if at < len(tokens) and (tokens[at] in "*+?" or tokens[at][0] == "{") else ""
        while at < len(tokens) and (tokens[at] in "*+?" or tokens[at][0] == "{"):
            at += 1
        optional = quantifier in ("*", "?") or quantifier.startswith(("{0", "{,"))
        plain = len(token) == 1 and token not in "^$.()" or len(token) == 2 and token[0] == "\\" and not token[1].isalnum()
        if inner and not optional:
            needed.append(inner)
        elif plain and not optional:
            run += token[-1].lower()
            run = close() if quantifier else run
        else:
            run = close()
    close()
    return [*out, _best(needed)], at


def _best(needed: list[frozenset]) -> frozenset:
    """Of sets of words of which a text needs one each, the rarest by looks: long words, then marks, then short words; empty: no sign."""
    return max(needed, key=lambda s: min(LONG - 0.5 if len(w) == 1 and not w.isalnum() and w != " " else len(w) for w in s), default=frozenset())


@lru_cache(maxsize=None)
def signs(pattern: str) -> frozenset:
    """Lower-case words of which each text that the pattern matches has one, whatever its case; empty if none is needed."""
    found, _ = _branches(_TOKEN.findall(re.sub(r"^\(\?[a-z]+\)", "", pattern)), 0)
    return frozenset().union(*found) if all(found) else frozenset()


def with_low(text: Column, body) -> Column:
    """body(text, the text in lower case), both computed once."""
    return let(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda x: body(x["t"], x["low"]))


def has_any(text: Column, patterns: tuple[str, ...] | list[str], flags: str, low: Column | None = None) -> Column:
    """Whether a pattern hits under these flags, as `rlike` of all of them says; each runs only where a sign of it is.

    low: the text, or one that begins with it, in lower case; lists of patterns over one text share it.
    """
    if low is None:
        return with_low(text, lambda t, low: has_any(t, patterns, flags, low))
    groups: dict[frozenset, list[str]] = {}
    for p in patterns:
        s = signs(p)
        groups.setdefault(frozenset() if not s else frozenset(["long"]) if min(map(len, s)) >= LONG else s, []).append(p)
    tests = []
    for ps in sorted(groups.values(), key=lambda ps: -len(ps)):
        words = sorted(frozenset().union(*map(signs, ps)) if all(map(signs, ps)) else [])
        words = [w for w in words if not any(v in w for v in words if v != w)]
        some = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) if len(words) > 1 else F.contains(low, F.lit(words[0])) if words else None
        found = text.rlike(f"(?{flags})" + "|".join(f"(?:{p})" for p in ps))
        tests.append(found if some is None else some & found)
    return reduce(lambda a, b: a | b, tests)
