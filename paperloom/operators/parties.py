"""Parties: what different sources say of one normalised name as one row, and groups of similar names."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import kept, running
from ..functions.text import normal_name

# Last words that do not tell two names apart.
SUFFIXES = ("inc", "incorporated", "corp", "corporation", "llc", "company", "co")
#: Pairs to compare for a name, from which on the names of a key are crowded: they are compared with those that open groups alone.
CROWD = 100
#: Names of a crowded key whose openers are settled at once, by one task.
CHUNK = 1 << 15


def merge_parties(parties: DataFrame) -> DataFrame:
    """(name, role, email, phone, company, aliases) per normalised name of (name, role, email, phone, company).

    Roles are sorted and joined by a comma, of the others the least value stays; empty values count as null, rows without a
    name go. aliases are the sorted spellings that differ from the normalised name. Sets are built map-side before the shuffle.
    """
    value = lambda c: F.nullif(F.col(c), F.lit(""))
    named = parties.where(value("name").isNotNull()).select(normal_name(F.col("name")).alias("key"), "name", *(value(c).alias(c) for c in ("role", "email", "phone", "company")))
    grouped = named.groupBy("key").agg(F.array_sort(F.collect_set("role")).alias("roles"), *(F.min(c).alias(c) for c in ("email", "phone", "company")), F.array_sort(F.collect_set("name")).alias("names"))
    roles = F.nullif(F.array_join("roles", ", "), F.lit(""))
    return grouped.select(F.col("key").alias("name"), roles.alias("role"), "email", "phone", "company", F.array_except("names", F.array("key")).alias("aliases"))


def base_name(normal: Column) -> Column:
    """A normalised name in lower case without a company suffix as its last word."""
    words = F.split(F.lower(normal), " ")
    short = F.array_join(F.slice(words, 1, F.size(words) - 1), " ")
    return F.when(F.element_at(words, -1).isin(*SUFFIXES), short).otherwise(F.lower(normal))


def _ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out, matcher, last = [0.0] * len(x), SequenceMatcher(None), None
        # the matcher prepares its second text; pairs in order of it prepare each once
        for i, p, q in sorted(zip(range(len(x)), x, y, strict=True), key=lambda t: t[2]):
            if q != last:
                matcher.set_seq2(q)
                last = q
            matcher.set_seq1(p)
            out[i] = matcher.ratio()
        return pd.Series(out, dtype="float64")

    return run(a, b)


def _grams(nodes: DataFrame, threshold: float) -> DataFrame:
    """(key, ord, base, n, gram): the rarest character pairs of each base, as many as any partner has to share one of.

    Bases of n and m characters and ratio t share at least (1.5 t - 1)(n + m) - 1 pairs, and m is at least n t / (2 - t).
    Repeated pairs are numbered, so that shared ones are counted as in bags.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.substring(F.col("base"), i, F.lit(2)))
    each = nodes.where("n > 1").select("key", "ord", "base", "n", F.posexplode(pairs).alias("at", "pair"))
    nth = F.row_number().over(Window.partitionBy("key", "ord", "pair").orderBy("at"))
    each = each.withColumn("gram", F.concat("pair", F.lit("#"), nth))
    rarity = each.groupBy("key", "gram").agg(F.count("*").alias("df"))
    share = (1.5 * threshold - 1) * (1 + threshold / (2 - threshold))
    shared = F.greatest(F.ceil(F.col("n") * share - 1 - 1e-9), F.lit(1))
    place = F.row_number().over(Window.partitionBy("key", "ord").orderBy("df", "gram"))
    return each.join(rarity, ["key", "gram"]).withColumn("place", place).where(F.col("place") <= F.col("n") - shared).select("key", "ord", "base", "n", "gram")


def similar_links(nodes: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(key, u, v): pairs u < v of (key, ord, base) with different bases that are as similar as the threshold asks.

    0.9 for names with equally many words, each equal to its partner or a beginning of it of at most 4 characters; else the
    matcher's ratio. Candidates share the first letters of all words, or one of their rarest character pairs; no pair that
    passes is missed from a threshold of 0.82 on.
    """
    if not 0.82 <= threshold <= 0.95:
        raise ValueError("the threshold lies between 0.82 and 0.95")
    sized = nodes.select("key", "ord", "base", F.char_length("base").alias("n"))
    grams = kept(_grams(sized, threshold), "party-grams")
    a, b = grams.alias("a"), grams.alias("b")
    near = (F.col("a.ord") < F.col("b.ord")) & (2 * F.least("a.n", "b.n") >= threshold * (F.col("a.n") + F.col("b.n")) - 1e-9)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.gram") == F.col("b.gram")) & near)
    pairs = met.select("a.key", F.col("a.ord").alias("u"), F.col("b.ord").alias("v"), F.col("a.base").alias("x"), F.col("b.base").alias("y"))
    # the matcher is the costly part: as many partitions as there are, also where the pairs take few bytes
    pairs = pairs.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "u", "v").dropDuplicates(["key", "u", "v"])
    links = pairs.where(_ratio(F.col("x"), F.col("y")) >= threshold).select("key", "u", "v")
    if threshold > 0.9:
        return links
    words = F.split("base", " ")
    lettered = sized.where("n > 0").select("key", "ord", words.alias("words"), F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), " ").alias("letters"))
    short = lettered.where(F.exists("words", lambda w: F.length(w) <= 4)).alias("s")
    long = lettered.alias("l")
    begins = F.forall(F.arrays_zip(F.col("s.words").alias("p"), F.col("l.words").alias("q")), lambda z: (z["p"] == z["q"]) | ((F.length(z["p"]) <= 4) & F.startswith(z["q"], z["p"])))
    met = short.join(long, (F.col("s.key") == F.col("l.key")) & (F.col("s.letters") == F.col("l.letters")) & (F.col("s.ord") != F.col("l.ord")) & begins)
    return links.unionByName(met.select("s.key", F.least("s.ord", "l.ord").alias("u"), F.greatest("s.ord", "l.ord").alias("v"))).distinct()


def _crowded(grams: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key) of the keys in which names that share grams make over CROWD pairs a name."""
    met = grams.groupBy("key", "gram").agg(F.count("*").cast("double").alias("n")).groupBy("key").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    return met.join(nodes.groupBy("key").agg(F.count("*").alias("n")), "key").where(F.col("pairs") > F.col("n") * CROWD).select("key")


def _common(a: str, codes: np.ndarray, letters: dict[str, int]) -> np.ndarray:
    """At least the characters that a has in common, in order, with each text, a column of a matrix of character codes (0: none).

    The longest common subsequence by bits, for all texts at once: the matcher's blocks are one, so its ratio asks for no more.
    Texts over 64 characters add up what their pieces have in common.
    """
    out = np.zeros(codes.shape[1], np.int64)
    for at in range(0, len(a), 64):
        piece = a[at : at + 64]
        masks = np.zeros(len(letters) + 1, np.uint64)
        for i, c in enumerate(piece):
            masks[letters.get(c, 0)] |= np.uint64(1 << i)
        masks[0] = 0
        open_ = np.full(codes.shape[1], np.uint64(2**64 - 1))
        for places in codes:
            hit = open_ & masks[places]
            open_ = (open_ + hit) | (open_ - hit)
        out += np.bitwise_count(~open_ & np.uint64((1 << len(piece)) - 1))
    return out


def _begins(p: str, q: str) -> bool:
    """Whether the names have equally many words, each of the one equal to the other's or a beginning of it of at most 4 characters."""
    x, y = p.split(" "), q.split(" ")
    return len(x) == len(y) and p != "" and q != "" and any(all(a == b or len(a) <= 4 and b.startswith(a) for a, b in zip(s, t, strict=True)) for s, t in ((x, y), (y, x)))


def _first_openers(openers: list[str], bases: list[str], threshold: float, grow: bool = False) -> np.ndarray:
    """For each base the place of the first opener that it is similar to, -1 for none.

    grow: the bases are the openers too; one that no earlier opener took opens a group, so it has its own place.
    """
    letters = {c: i for i, c in enumerate(sorted(set().union(*bases)), 1)}
    size = np.array([len(b) for b in bases], np.int64)
    codes = np.zeros((max(map(len, bases), default=0), len(bases)), np.min_scalar_type(len(letters)))
    for i, b in enumerate(bases):
        codes[: len(b), i] = [letters[c] for c in b]
    # a beginning may be far shorter than the name: tried where the first letters agree and one side has a word of up to 4 characters
    begins = threshold <= 0.9
    initials = lambda b: " ".join(w[:1] for w in b.split(" "))
    short = np.array([any(len(w) <= 4 for w in b.split(" ")) for b in bases], bool)
    alike: dict[str, list[int]] = {}
    for i, b in enumerate(bases if begins else []):
        alike.setdefault(initials(b), []).append(i)
    same = {h: np.array(x) for h, x in alike.items()}
    same_short = {h: x[short[x]] for h, x in same.items()}
    none = np.zeros(0, np.int64)
    out, live, matcher = np.full(len(bases), -1, np.int64), np.arange(len(bases)), SequenceMatcher(None)
    texts = codes
    for k, a in enumerate(bases if grow else openers):
        if grow:
            if out[k] >= 0:
                continue
            out[k] = k
        free = out[live] < 0
        n_free = np.count_nonzero(free)
        if not n_free:
            break
        if n_free < 0.9 * len(live):
            live = live[free]
            texts, free = np.ascontiguousarray(codes[:, live]), out[live] < 0
        # bound of the ratio: twice what is common over both lengths
        near = live[free & (2 * _common(a, texts, letters) >= threshold * (len(a) + size[live]) - 1e-9)]
        for i in near.tolist():
            matcher.set_seqs(a, bases[i])
            if matcher.ratio() >= threshold:
                out[i] = k
        if begins:
            own = any(len(w) <= 4 for w in a.split(" "))
            met = (same if own else same_short).get(initials(a), none)
            for i in met[out[met] < 0].tolist():
                if _begins(a, bases[i]):
                    out[i] = k
    return out


def _settled(chunk: DataFrame, threshold: float) -> DataFrame:
    """(key, ord, base, opener) of (key, ord, base), a bounded number for each key: openers are their own."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("ord").combine_chunks()
        first = _first_openers([], t.column("base").to_pylist(), threshold, grow=True)
        return t.append_column("opener", t.column("ord").take(pa.array(first)))

    kind = {f.name: f.dataType.simpleString() for f in chunk.schema}
    return chunk.groupBy("key").applyInArrow(run, f"key {kind['key']}, ord {kind['ord']}, base string, opener {kind['ord']}")


def _taken(names: DataFrame, openers: DataFrame, threshold: float) -> DataFrame:
    """(key, ord, opener): the names (key, ord, base) that are similar to an opener (key, ord, base) of their key, and the first such.

    Blocks of names meet all openers of their key, which are one chunk's at most; no pair is a row.
    """
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, names.count() // CHUNK + 1)
    a = names.withColumn("block", F.pmod(F.xxhash64("ord"), F.lit(blocks)).cast("int"))
    b = openers.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by("ord").combine_chunks()
        first = _first_openers(y.column("base").to_pylist(), x.column("base").to_pylist(), threshold)
        hit = np.flatnonzero(first >= 0)
        return x.select(["key", "ord"]).take(pa.array(hit)).append_column("opener", y.column("ord").take(pa.array(first[hit])))

    kind = {f.name: f.dataType.simpleString() for f in names.schema}
    return a.groupBy("key", "block").cogroup(b.groupBy("key", "block")).applyInArrow(run, f"key {kind['key']}, ord {kind['ord']}, opener {kind['ord']}")


def _crowd_openers(nodes: DataFrame, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """Of nodes (key, ord, base) those of keys that are not crowded, or no longer, and tables (key, ord, opener) of the others.

    A chunk of CHUNK names of each crowded key settles its openers in one task, then all later names look for the first of
    them that they are similar to. What a key has left goes on in the next round, or leaves where it is crowded no more.
    """
    grams = kept(_grams(nodes.select("key", "ord", "base", F.char_length("base").alias("n")), threshold).select("key", "ord", "gram"), "party-crowds")
    hot = kept(_crowded(grams, nodes), "party-crowded")
    if hot.isEmpty():
        return nodes, []
    calm = [nodes.join(hot, "key", "left_anti").select("key", "ord", "base")]
    live = kept(running(nodes.join(hot, "key", "left_semi"), ["key"], ["ord"]).select("key", "ord", "base", "number"), "party-live")
    last, upto, done = live.agg(F.max("number")).first()[0], 0, []
    while upto < last:
        upto += CHUNK
        chunk = kept(_settled(live.where(F.col("number") <= upto).select("key", "ord", "base"), threshold), "party-chunk")
        done.append(chunk.where("ord != opener").select("key", "ord", "opener"))
        live = live.where(F.col("number") > upto)
        if upto >= last:
            break
        now = kept(_taken(live.select("key", "ord", "base"), chunk.where("ord = opener").select("key", "ord", "base"), threshold), "party-taken")
        done.append(now)
        live = kept(live.join(now, ["key", "ord"], "left_anti"), "party-live")
        hot = kept(_crowded(grams.join(live.select("key", "ord"), ["key", "ord"], "left_semi"), live), "party-crowded")
        calm.append(live.join(hot, "key", "left_anti").select("key", "ord", "base"))
        live = live.join(hot, "key", "left_semi")
        last = live.agg(F.max("number")).first()[0] or 0
    return kept(reduce(DataFrame.unionByName, calm), "party-calm"), done


def _link_openers(nodes: DataFrame, threshold: float) -> DataFrame:
    """(key, ord, opener) of the names (key, ord, base) that an opener takes, from all links between them."""
    links = kept(similar_links(nodes, threshold), "party-links")
    live, taken = links, []
    while not live.isEmpty():
        openers = live.select("key", "u").distinct().join(live.select("key", F.col("v").alias("u")).distinct(), ["key", "u"], "left_anti")
        now = kept(live.join(openers, ["key", "u"], "left_semi").select("key", "v").distinct(), "party-taken")
        taken.append(now)
        live = live.join(now, ["key", "v"], "left_anti").join(now.withColumnRenamed("v", "u"), ["key", "u"], "left_anti")
        live = kept(live, "party-live")
    joined = links
    if taken:
        gone = reduce(DataFrame.unionByName, taken).distinct()
        joined = links.join(gone.withColumnRenamed("v", "u"), ["key", "u"], "left_anti")
    return joined.groupBy("key", F.col("v").alias("ord")).agg(F.min("u").alias("opener"))


def similar_groups(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(key, canonical, members) of groups of two or more similar names among (key, ord, name); ord is distinct in a key.

    In the order of ord each name that no earlier group took opens one and takes all later names similar to it. Of equal
    normalised names only the first counts. canonical is the normalised longest member, the first of equals; members keep
    their spelling and order. Null names go. Which names open groups is settled in rounds: a name without an undecided
    earlier partner opens one, and its partners are taken. Each round is a few joins on links, none of names or in the driver.
    Where too many names of a key are alike for that, they are compared with openers alone, chunk by chunk in their order.
    """
    normal = names.where(F.col("name").isNotNull()).select("key", "ord", "name", normal_name(F.col("name")).alias("normal"))
    first = normal.groupBy("key", "normal").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name")).withColumn("base", base_name(F.col("normal")))
    first = kept(first.withColumn("head", F.min("ord").over(Window.partitionBy("key", "base"))), "party-names")
    # equally based names are alike to any other name, so their first stands for them
    heads = first.where("ord = head").select("key", "ord", "base")
    calm, crowds = _crowd_openers(heads, threshold)
    opener = reduce(DataFrame.unionByName, crowds, _link_openers(calm, threshold)).withColumnRenamed("ord", "head")
    placed = first.join(opener, ["key", "head"], "left").withColumn("opener", F.coalesce("opener", "head"))
    longest = F.max_by("normal", F.struct(F.char_length("name"), -F.col("ord")))
    grouped = placed.groupBy("key", "opener").agg(longest.alias("canonical"), F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("m"))
    return grouped.where(F.size("m") > 1).select("key", "canonical", F.transform("m", lambda x: x["name"]).alias("members"))
