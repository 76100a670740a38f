"""Chat formatting: turns of typed content parts become one string with a loss mask, reversibly."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from hashlib import sha256
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import col

#: The control strings of the template. A turn is OPEN role MID text CLOSE.
OPEN, MID, CLOSE = "<|turn>", "<|says|>", "<|end|>\n"
#: Texts and roles must not hold what could be taken for control strings of this or other templates: the escape
#: sign goes behind the first character of each run below, and in runs that already have one, one more goes there.
ESCAPE = "\u2060"
_RISKY = re.compile(f"([<\\[]){ESCAPE}*(?=[|/A-Za-z])")
_ESCAPED = re.compile(f"([<\\[]){ESCAPE}(?={ESCAPE}*[|/A-Za-z])")


def escape(text: str) -> str:
    return _RISKY.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattened:
    text: str = ""
    attachments: list[dict] = field(default_factory=list)


def _number(value, otherwise: float) -> float:
    """A finite number of at least 0, or `otherwise` where the value is none."""
    try:
        found = float(value)
    except (TypeError, ValueError, OverflowError):
        return otherwise
    return found if 0 <= found < 1e12 else otherwise


def _text(value) -> str:
    """A string as it is, null as none, any other value as its JSON."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


class PartVisitor:
    """Flattens typed parts into text with ordered placeholders; each kind has a visit_ method.

    An attachment's record holds its number, its kind, its reference, `at` (the code point of the flattened text at which
    its placeholder starts, which tells it from text that only looks like one) and the tokens it expands to: images by
    tiles of tile x tile pixels, audio by seconds, documents by pages. Measures that are no finite numbers of at least 0
    count as absent: one tile, no seconds, one page. Unknown kinds are attachments of zero tokens; parts that are no
    objects are text, and so is what a text part holds, by its JSON where it is no string.
    """

    def __init__(self, tile: int = 512, tokens_per_tile: int = 170, base_image_tokens: int = 85, tokens_per_second: int = 25, tokens_per_page: int = 600):
        self.tile, self.per_tile, self.base = tile, tokens_per_tile, base_image_tokens
        self.per_second, self.per_page = tokens_per_second, tokens_per_page

    def flatten(self, content) -> Flattened:
        out = Flattened()
        for part in content if isinstance(content, list) else [content]:
            if not isinstance(part, dict):
                part = {"type": "text", "text": part}
            getattr(self, f"visit_{part.get('type')}", self.visit_other)(part, out)
        return out

    def visit_text(self, part: dict, out: Flattened) -> None:
        out.text += _text(part.get("text"))

    def visit_image(self, part: dict, out: Flattened) -> None:
        across, down = (max(1, ceil(_number(part.get(k), self.tile) / self.tile)) for k in ("width", "height"))
        self._attach("image", part, self.base + self.per_tile * across * down, out)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        self._attach("audio", part, ceil(int(_number(part.get("seconds"), 0) * 1000) * self.per_second / 1000), out)

    def visit_document(self, part: dict, out: Flattened) -> None:
        self._attach("document", part, int(_number(part.get("pages"), 1)) * self.per_page, out)

    def visit_other(self, part: dict, out: Flattened) -> None:
        self._attach(_text(part.get("type")), part, 0, out)

    def _attach(self, kind: str, part: dict, tokens: int, out: Flattened) -> None:
        number = len(out.attachments)
        ref = _text(part.get("ref")) or _text(part.get("url"))
        out.attachments.append({"number": number, "kind": kind, "ref": ref, "at": len(out.text), "tokens": tokens})
        out.text += placeholder(kind, number)


def placeholder(kind: str, number: int) -> str:
    return f"{{{{{kind}:{number}}}}}"


def parts_of(text: str, attachments: list[dict]) -> list[str | dict]:
    """The texts and attachments of a flattened turn, in order: what lies outside the recorded placeholders is text."""
    out: list[str | dict] = []
    end = 0
    for a in sorted(attachments, key=lambda a: a["at"]):
        if a["at"] > end:
            out.append(text[end : a["at"]])
        out.append(a)
        end = a["at"] + len(placeholder(a["kind"], a["number"]))
    return [*out, text[end:]] if end < len(text) else out


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the (start, end) code-point ranges under the loss: the escaped assistant texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{MID}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string, unescaped."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        mid = formatted.index(MID, at)
        end = formatted.index(CLOSE, mid)
        turns.append((unescape(formatted[at + len(OPEN) : mid]), unescape(formatted[mid + len(MID) : end])))
        at = end + len(CLOSE)
    return turns


FORMATTED_SCHEMA = "formatted string, loss_starts array<int>, loss_ends array<int>, attachments string, attachment_tokens long"


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", typed: bool = False, visitor: PartVisitor | None = None) -> DataFrame:
    """One row per conversation: conv, n_turns and FORMATTED_SCHEMA.

    Rows go by turn (null first; ties by role, then text). A null text or role is empty. Rows without a
    conversation id form one of their own. Every turn goes through the visitor: with typed, texts that are JSON lists
    hold content parts; all others are a text part.
    The one string of a conversation has to fit a task, as any row has to; no more than its turns meet there.
    """
    kind = turns.schema[conv].dataType.simpleString()
    packed = turns.groupBy(col(conv).alias("conv__")).agg(
        F.sort_array(F.collect_list(F.struct(col(turn).alias("n"), F.coalesce(col(role), F.lit("")).alias("r"), F.coalesce(col(text), F.lit("")).alias("t")))).alias("turns__")
    )
    visitor = visitor or PartVisitor()
    packed = packed.select("conv__", F.transform("turns__", lambda x: x.r).alias("roles"), F.transform("turns__", lambda x: x.t).alias("texts"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = []
                for roles, texts in zip(b.column(1).slice(i, 256).to_pylist(), b.column(2).slice(i, 256).to_pylist(), strict=True):
                    flat = [visitor.flatten(_parts(t) if typed else t) for t in texts]
                    found = [{"turn": k, **a} for k, f in enumerate(flat) for a in f.attachments]
                    out, spans = format_turns(list(zip(roles, (f.text for f in flat), strict=True)))
                    rows.append((len(roles), out, [s for s, _ in spans], [e for _, e in spans], json.dumps(found), sum(a["tokens"] for a in found)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.int64()]
                names = ["n_turns", "formatted", "loss_starts", "loss_ends", "attachments", "attachment_tokens"]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[conv, *names])

    return packed.mapInArrow(run, f"`{conv}` {kind}, n_turns long, {FORMATTED_SCHEMA}")


def _parts(text: str):
    if text[:1] == "[":
        try:
            parts = json.loads(text)
        except (ValueError, RecursionError):
            return text
        if isinstance(parts, list) and all(isinstance(p, (dict, str)) or p is None for p in parts):
            return parts
    return text


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of each formatted conversation, from its string and loss ranges alone, and its attachments with their tokens."""
    rows = formatted.select(conv, "formatted", "loss_starts", "loss_ends", "attachments", "attachment_tokens")
    kind = rows.schema[conv].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out = []
                for text, starts, ends in zip(*(b.column(k).slice(i, 256).to_pylist() for k in (1, 2, 3)), strict=True):
                    turns = read_turns(text)
                    loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
                    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                    out.append((len(turns), sha256(whole.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
                columns = zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)
                names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachments", "attachment_tokens"]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), *(pa.array(c, k) for c, k in columns), *(b.column(k).slice(i, 256) for k in (4, 5))], names=names)

    return rows.mapInArrow(run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachments string, attachment_tokens long")
