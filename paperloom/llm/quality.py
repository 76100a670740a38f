"""Quality rules of documents and of their hosts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import flat
from .shared import col, kept, map_columns, spare

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5


def text_counts(texts) -> dict[str, np.ndarray]:
    """The five counts of each text of an Arrow string array; a null text has none of anything."""
    buf, offs = flat.flat_bytes(texts)
    out = {k: np.zeros(len(offs) - 1, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for i, j in flat.chunks(offs):
        own = offs[i : j + 1] - offs[i]
        raw = buf[offs[i] : offs[j]]
        for k, v in _chunk_counts(raw, own).items():
            out[k][i:j] = v
    return out


def _chunk_counts(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    starts, ends, doc = flat.word_spans(raw, offs)
    prefix = flat.prefix_hash(raw)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[raw])))
    chars = points[ends] - points[starts]
    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": np.bincount(doc, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]],
    }
    # lines that hold a word: each is keyed by the line's hash in its text
    cuts = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate((offs[:-1], cuts + 1)))
    begin = begin[begin < len(raw)]
    stop = np.concatenate((begin[1:], [len(raw)]))
    if len(begin):
        ended = (raw[stop - 1] == 10) & (stop > begin)
        stop = stop - ended
        worded = np.searchsorted(starts, stop, "left") > np.searchsorted(starts, begin, "left")
        begin, stop = begin[worded], stop[worded]
    owner = np.searchsorted(offs, begin, "right") - 1

    def same_line(i, j):
        return flat.equal_spans(raw, begin[i], stop[i], raw, begin[j], stop[j])

    again = _repeats(flat.span_hash(prefix, begin, stop), owner, True, same_line, lambda i: raw[begin[i] : stop[i]].tobytes())
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n)
    words = flat.span_hash(prefix, starts, ends)
    count = out["n_words"]
    first = np.concatenate(([0], np.cumsum(count)))
    full = np.flatnonzero(np.arange(len(words)) - first[doc] + WINDOW <= count[doc])
    h = np.zeros(len(full), np.uint64)
    for k in range(WINDOW):
        h += words[full + k] * flat.SHINGLE_KEYS[k]

    def same_window(i, j):
        same = np.ones(len(i), bool)
        for k in range(WINDOW):
            a, b = full[i] + k, full[j] + k
            same &= flat.equal_spans(raw, starts[a], ends[a], raw, starts[b], ends[b])
        return same

    def window(i):
        return tuple(raw[starts[k] : ends[k]].tobytes() for k in range(full[i], full[i] + WINDOW))

    seen = full[_repeats(flat.mix(h), doc[full], False, same_window, window)]
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, seen, 1)
    np.add.at(step, seen + WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return out


def _repeats(h: np.ndarray, owner: np.ndarray, later_only: bool, same, content) -> np.ndarray:
    """Positions of what stands in its text twice or more; later_only leaves out the first.

    Equal hashes propose neighbours, same(i, j) compares what they stand for. Should any differ, the contents
    themselves take the place of the hashes.
    """
    order = np.lexsort((h, owner))
    a, b = h[order], owner[order]
    alike = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    at = np.flatnonzero(alike)
    if len(at) and same is not None and not same(order[at], order[at + 1]).all():
        known: dict = {}
        exact = np.array([known.setdefault((o, content(i)), len(known)) for i, o in enumerate(owner.tolist())], np.uint64)
        return _repeats(exact, owner, later_only, None, None)
    flag = np.zeros(len(h), bool)
    flag[1:] |= alike
    if not later_only:
        flag[:-1] |= alike
    return order[flag]


def with_counts(docs: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with the five counts; columns of these names are replaced. drop_text leaves out the text."""
    names = [x.split()[0] for x in BASE_SCHEMA.split(", ")]
    docs = docs.drop(*names)
    at = docs.columns.index(text)
    left = [k for k, f in enumerate(docs.schema) if not (drop_text and k == at)]

    def run(batches):
        for b in batches:
            counts = text_counts(b.column(at))
            yield [*(b.column(k) for k in left), *(pa.array(counts[k]) for k in names)]

    return map_columns(docs, run, [*(docs.schema[k] for k in left), *StructType.fromDDL(BASE_SCHEMA)])


def base_failed(min_words: int = 10, max_repeat_percent: int = 20):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def more_rules(max_symbol_share: float = 0.1, max_dup_line_share: float = 0.3, min_word_chars: float = 2, max_word_chars: float = 15) -> dict[str, Column]:
    """Further rules on the counts, for `judge`: too many symbols or repeated lines for the words, words too short or too long on the whole."""
    mean = F.col("word_chars") / F.nullif(F.col("n_words"), F.lit(0))
    return {
        "symbols": F.col("n_symbols") > max_symbol_share * F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") * 10 > max_dup_line_share * F.col("n_words"),
        "word_length": F.coalesce((mean < min_word_chars) | (mean > max_word_chars), F.lit(False)),
    }


def host_verdicts(counted: DataFrame, host: str = "source", prior_hosts_min: int = 2, max_rate: float = 0.5, failed: str = "base_failed") -> DataFrame:
    """(host, n_docs, n_failed, rate, host_failed): the share of failing documents of each host, shrunk.

    The prior is a beta distribution fitted by moments to the raw rates of all hosts, weighted by their
    documents: with mean m and between-host variance v beyond what draws of their size explain, its weight
    is m * (1 - m) / v - 1 documents. Hosts beyond max_rate after shrinking fail. Documents without a host
    are a host of their own (null). With fewer than prior_hosts_min hosts, or no variance beyond chance,
    the prior is as heavy as all documents together. Only sums over hosts reach the prior's single row.
    """
    hosts = counted.groupBy(col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(col(failed).cast("long")).alias("n_failed"))
    return _shrunk(hosts, [], prior_hosts_min, max_rate).select("host", "n_docs", "n_failed", "rate", "host_failed")


def _shrunk(hosts: DataFrame, keys: list[str], prior_hosts_min: int, max_rate: float) -> DataFrame:
    """hosts with rate and host_failed; a prior for each value of the keys (none: one for all)."""
    p = F.col("n_failed") / F.col("n_docs")
    sums = hosts.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"),
        F.sum(F.col("n_docs") * p * p).alias("npp"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("nn"),
    )
    m = F.col("f") / F.col("n")
    within = m * (1 - m)
    # E[sum n (p - m)^2] = within * (k - 1) + v * (n - nn / n)
    v = (F.col("npp") - F.col("n") * m * m - within * (F.col("k") - 1)) / F.nullif(F.col("n") - F.col("nn") / F.col("n"), F.lit(0.0))
    weight = F.when((F.col("k") >= prior_hosts_min) & (v > 0), F.greatest(within / v - 1, F.lit(1.0))).otherwise(F.col("n").cast("double"))
    prior = sums.select(*keys, m.alias("prior_rate"), weight.alias("prior_docs"))
    rate = (F.col("n_failed") + F.col("prior_rate") * F.col("prior_docs")) / (F.col("n_docs") + F.col("prior_docs"))
    # a row for each rule meets its hosts: the prior is as small as the list of rules by construction
    joined = hosts.join(F.broadcast(prior), keys or F.lit(True)).withColumn("rate", rate)
    return joined.withColumn("host_failed", F.col("rate") > max_rate)


def rule_verdicts(counted: DataFrame, rules: dict[str, Column], host: str = "source", prior_hosts_min: int = 2, max_rate: float = 0.5) -> DataFrame:
    """(host, rule, n_docs, n_failed, rate, host_failed): as host_verdicts for each of several rules, each with a prior of its own.

    One pass over the documents sums the failures of all rules; a null verdict of a rule is no failure.
    """
    sums = counted.groupBy(col(host).alias("host")).agg(F.count("*").alias("n_docs"), *(F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in rules.items()))
    long = sums.select("host", "n_docs", F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), col(name).alias("n_failed")) for name in rules))).alias("r")).select("host", "n_docs", "r.*")
    return _shrunk(long, ["rule"], prior_hosts_min, max_rate).select("host", "rule", "n_docs", "n_failed", "rate", "host_failed")


def judge(counted: DataFrame, host: str = "source", min_words: int = 10, max_repeat_percent: int = 20, rules: dict[str, Column] | None = None, **verdicts) -> DataFrame:
    """Rows with counts, with base_failed, host_rate, host_failed and kept (columns of these names are replaced).

    kept: neither the row nor its host fails. A host fails by the rate of base_failed, or with further rules (as of
    more_rules) by that of any of these too: host_rate is the largest of its rates. Further rules judge hosts alone.
    """
    counted = counted.drop("base_failed", "kept", "host_rate", "host_failed")
    counted = counted.withColumn("base_failed", base_failed(min_words, max_repeat_percent))
    own = spare("host", counted)
    if rules:
        found = rule_verdicts(counted, {"base": F.col("base_failed"), **rules}, host, **verdicts)
        found = found.groupBy("host").agg(F.max("rate").alias("rate"), F.bool_or("host_failed").alias("host_failed"))
    else:
        found = host_verdicts(counted, host, **verdicts)
    # as a table, so that Spark knows its size before it plans the join: a few hosts are broadcast, many are not
    of_hosts = kept(found, "quality-hosts").select(F.col("host").alias(own), F.col("rate").alias("host_rate"), "host_failed")
    joined = counted.join(of_hosts, col(host).eqNullSafe(col(own)), "left").drop(own)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def quality(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """docs with counts, base_failed, the host's shrunk rate and kept.

    Null and empty texts have no words, so they fail; repeated rows are judged alike; an empty table stays empty.
    Columns with the name of a result are replaced, all others stay.
    """
    return judge(with_counts(docs, text), host, **limits)
