"""Variant spellings of names typed by people (problem 3).

A name's words are telling or common: words that many names have beside many different words (trades, first names), their
misspellings and abbreviations are common. The telling words of a spelling become a vector of character n-grams, weighted
by how rare they are, and a sparse join finds the pairs whose cosine reaches a threshold: n-grams are taken rarest first,
and only as many as are needed for no pair above the threshold to be missed (prefix filter) are joined. An exact check
follows: telling words must agree up to one edit, and what else the names hold must not contradict. The links split the
spellings into components, and each component is grouped by average-linkage clustering of the cosines: by one task, or, if
it is large, in rounds over the cluster.
"""

from __future__ import annotations

import heapq
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setaudit.session import cut, unsized

# Entries that name nobody in particular; legal forms, articles and titles, which tell names apart in no way.
NOBODY = frozenset(
    "unknown anonymous anon various none null nil na n/a tba tbd misc other others unlicensed unreleased bootleg bootlegs pirate hack homebrew prototype "
    "nobody nothing test todo private self untitled unidentified undefined unspecified missing not".split()
)
NOBODY_PHRASES = frozenset({"public domain", "not known", "not available", "not applicable", "no data", "various artists", "see notes", "to be announced", "do not know", "dont know", "unknown manufacturer", "unknown company"})
LEGAL = frozenset("inc incorporated ltd limited co company corp corpn corporation gmbh kk sa ag kg bv nv oy ab as plc llc llp lp srl spa sl sarl kabushiki kaisha kaisya the and mr mrs ms dr".split())


def bare(name: str) -> str:
    """Without accents, in lower case. Dots and quotes inside words vanish; a capital after a small letter or a hyphen
    begins a word, other hyphens join; other signs part words."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    folded = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])|(?<=\w)[-‐‑](?=[A-Z])", " ", folded)
    folded = re.sub(r"(?<=\w)[-'’‐‑](?=\w)", "", folded).casefold()
    folded = re.sub(r"(?<=\b\w)\.\s?(?=\w\b)", "", folded)
    return re.sub(r"[\W_]+", " ", folded).strip()


def words_of(name: str) -> list[str]:
    text = bare(name)
    if not text or text in NOBODY_PHRASES or set(text.split()) <= NOBODY:
        return []
    initials = {re.sub(r"\W", "", x).casefold() for x in re.findall(r"\b(?:\w\.\s?)+(?:\w\b)?", name)} - LEGAL
    kept = [x for w in text.split() if w not in LEGAL for x in (w if w in initials else (w,))]
    return kept if any(len(w) > 1 for w in kept) else text.split()


def alias_of(name: str) -> tuple[str, str] | None:
    """Short form and long form of an entry like `ABC (Abrasive Bell Company)`."""
    m = re.fullmatch(r"\s*([\w.&-]{2,8})\s*\(\s*(.{5,})\s*\)\s*", name)
    return (bare(m[1]).replace(" ", ""), m[2]) if m else None


def one_edit(a: str, b: str) -> bool:
    """Whether one changed, missing, added or swapped letter, or none, turns one word into the other."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x == y[1:] or x[1:] == y or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


def shortened(a: str, b: str) -> bool:
    """Whether the shorter word may be the longer one's abbreviation: its beginning, or up to five of its letters in order, the first included."""
    short, long = sorted((a, b), key=len)
    rest = iter(long)
    return long.startswith(short) or (short[0] == long[0] and len(short) <= 5 and all(c in rest for c in short))


class Common:
    """Tells whether a word is common: one of the given words, a misspelling (from five letters on) or abbreviation of one."""

    def __init__(self, words: list[str]):
        self.words, self.known = frozenset(words), {}
        self.near: dict[str, list[str]] = {}
        for w in words:
            if len(w) >= 5:
                for x in self._less(w):
                    self.near.setdefault(x, []).append(w)
        self.by_initial: dict[str, list[str]] = {}
        for w in words:
            self.by_initial.setdefault(w[0], []).append(w)

    @staticmethod
    def _less(w: str) -> set[str]:
        return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}

    def __contains__(self, w: str) -> bool:
        if w not in self.known:
            self.known[w] = (
                w in self.words or len(w) == 1 or (len(w) >= 5 and any(one_edit(w, c) for x in self._less(w) for c in self.near.get(x, ()))) or any(len(w) < len(c) and shortened(w, c) for c in self.by_initial.get(w[0], ()))
            )
        return self.known[w]


def read_name(words: list[str], common: Common) -> tuple[str, str]:
    """The telling words, and the initials of the others; a name of common words alone is telling as a whole."""
    telling = sorted({w for w in words if w not in common}) or sorted(set(words))
    return " ".join(telling), "".join(sorted({w[0] for w in words if w not in telling}))


def verdict(a: str, others_a: str, b: str, others_b: str) -> int:
    """1 if two readings agree, -1 if they contradict each other, 0 if neither.

    They agree if a telling word of one is a telling word of the other up to one edit (from five letters on; shorter ones
    must be equal). Words that stand in one name alone say nothing; where both have such words one of the one side must
    begin like one of the other side, and unmatched telling words must be short for one another, or one short and alike in two letters at the beginning.
    """
    left, right, hit = a.split(), b.split(), False
    for w in sorted(left, key=len, reverse=True):
        same = next((x for x in right if x == w), None) or next((x for x in right if len(w) >= 5 and len(x) >= 5 and one_edit(w, x)), None)
        if same is not None:
            left.remove(w)
            right.remove(same)
            hit = True
    apart = {*others_a, *(w[0] for w in left if hit)}, {*others_b, *(w[0] for w in right if hit)}
    if all(apart) and not apart[0] & apart[1]:
        return -1
    if hit and left and right and not any(shortened(x, y) or (x[:2] == y[:2] and min(len(x), len(y)) <= 5) for x in left for y in right):
        return -1
    return int(hit)


def read_as(names: DataFrame) -> DataFrame:
    """(name, words): the words of each distinct name that names somebody. A short form that stands alone is read as the
    long form it is given for elsewhere, if that is the only one."""

    @F.pandas_udf("struct<short: string, long: string>")
    def alias(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([alias_of(x) or (None, None) for x in s], columns=["short", "long"])

    @F.pandas_udf("string")
    def short_form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: bare(x).replace(" ", ""))

    @F.pandas_udf("array<string>")
    def word_list(s: pd.Series) -> pd.Series:
        return s.map(lambda x: words_of((alias_of(x) or ("", x))[1]))

    known = names.where(F.col("name").rlike(r"^\s*[\w.&-]{2,8}\s*\(.*\)\s*$"))
    meanings = known.select(alias("name").alias("a")).where("a.short IS NOT NULL").groupBy("a.short").agg(F.min("a.long").alias("long"), F.count_distinct(F.lower("a.long")).alias("n")).where("n = 1").drop("n")
    read = names.withColumn("short", F.when(F.length(F.trim("name")) <= 8, short_form("name"))).join(meanings, "short", "left")
    return read.select("name", word_list(F.coalesce("long", "name")).alias("words")).where(F.size("words") > 0)


def common_words(names: DataFrame, spellings: int, share: float) -> list[str]:
    """Words of at least `share` of all names, and of more names than one entity has `spellings`, that stand beside many
    different words (a quarter as many as names). A name has few words, so there are at most a few times 1/share of them,
    however many names there are."""
    least = max(spellings, share * names.count())
    words = names.select(F.array_distinct("words").alias("words"))
    counts = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    beside = words.select(F.explode("words").alias("word"), "words").join(counts, "word").select("word", "n", F.explode("words").alias("by")).distinct().groupBy("word", "n").agg(F.count("*").alias("k"))
    return sorted(r.word for r in beside.where(F.col("k") >= 0.25 * F.col("n")).collect())


def readings(names: DataFrame, common: list[str]) -> DataFrame:
    """(name, telling, others): what is compared of each name."""

    @F.pandas_udf("struct<telling: string, others: string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Common(common)
        for s in batches:
            yield pd.DataFrame([read_name(list(w), known) for w in s], columns=["telling", "others"])

    return names.select("name", read("words").alias("r")).select("name", "r.telling", "r.others")


def weighted(texts: DataFrame, size: int = 3) -> DataFrame:
    """(id, gram, df, weight, rest) of (id, telling): unit vectors of the words' framed n-grams, a gram weighing by the root
    of the logarithm of its rarity. `rest` is the norm of this gram and all more common ones of the text."""
    total = texts.count()
    framed = F.transform(F.split("telling", " "), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    grams = F.flatten(F.transform(framed, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - (size - 1))), lambda i: F.substring(w, i, size))))
    pairs = texts.select("id", F.explode(F.array_distinct(grams)).alias("gram"))
    df = pairs.groupBy("gram").agg(F.count("*").alias("df"))
    raw = pairs.join(df, "gram").withColumn("raw", F.sqrt(F.log(F.lit(total + 1.0) / F.col("df"))))
    whole = Window.partitionBy("id")
    onward = whole.orderBy(F.col("df"), "gram").rowsBetween(0, Window.unboundedFollowing)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(whole))
    rest = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(onward)) / norm
    return raw.withColumn("rest", rest).withColumn("weight", F.col("raw") / norm).select("id", "gram", "df", "weight", "rest")


def cosine_links(vectors: DataFrame, least: float, tail: float = 0.1, block: int = 2000) -> DataFrame:
    """(a, b, sim): every pair a < b of cosine `least` or more.

    Grams are ordered from rare to common, the same for all. Of each vector the part before its `tail` (the common grams
    whose norm is below it) is joined, adding up products. What the pair has beyond both heads lies in the tail of one
    of them and adds less than `tail`, so pairs whose sum is below `least - tail` are dropped before the exact product.
    A gram of more than `block` vectors is joined in blocks, so no gram is one task's work.
    """
    heads = vectors.where(F.col("rest") >= tail).withColumn("blocks", F.ceil(F.col("df") / block).cast("int"))
    left = heads.select("gram", F.col("id").alias("a"), F.col("weight").alias("x"), F.pmod(F.hash("id"), "blocks").alias("part"))
    right = heads.select("gram", F.col("id").alias("b"), F.col("weight").alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    found = left.join(right, ["gram", "part"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("head")).where(F.col("head") >= least - tail).select("a", "b")
    lists = vectors.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "weight"))).alias("v"))
    both = found.join(lists.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(lists.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    product = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e.value * F.coalesce(F.element_at("vb", e.key), F.lit(0.0)))
    return both.select("a", "b", product.alias("sim")).where(F.col("sim") >= least)


def judged_links(pairs: DataFrame) -> DataFrame:
    """(a, b, sim, strong) of pairs with readings: strong where they agree; where they contradict each other `sim` is -1."""

    @F.pandas_udf("int")
    def judge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for ta, oa, tb, ob in batches:
            yield pd.Series([verdict(*x) for x in zip(ta, oa, tb, ob)], dtype="int32")

    said = pairs.withColumn("said", judge("telling_a", "others_a", "telling_b", "others_b"))
    return said.select("a", "b", F.when(F.col("said") < 0, -1.0).otherwise(F.col("sim")).alias("sim"), (F.col("said") > 0).alias("strong"))


def best_links(links: DataFrame, top_n: int) -> DataFrame:
    """The strong links, all of them, and of the others those that are among the `top_n` most similar of either end.

    The bound takes nothing from the components, which strong links alone make; of the evidence inside a component it takes
    what lies beyond a reading's `top_n` nearest.
    """
    ends = links.where("NOT strong").withColumn("of", F.explode(F.array("a", "b")))
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc(F.abs("sim")), "a", "b"))
    weak = ends.withColumn("r", rank).where(F.col("r") <= top_n).drop("of", "r").distinct()
    return links.where("strong").unionByName(weak)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. Labels spread along links and then jump to their label's label, until none changes."""
    both = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    for n in itertools.count(1):
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        spread = label.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("j"))
        new = cut(spread.join(jump, "component", "left").select("id", "old", F.least("component", "j").alias("component")))
        label = new.select("id", "component") if n % 8 else unsized(new.select("id", "component"))
        if not new.where("old <> component").limit(1).count():
            break
    return label


def average_linkage(a: np.ndarray, b: np.ndarray, sim: np.ndarray, least: float) -> dict[int, int]:
    """Cluster of each member of one component: the two clusters with the greatest mean similarity over all pairs of
    members (0 for pairs without a link) are joined while it reaches `least`; ties go to the smallest ids."""
    near: dict[int, dict[int, float]] = {}
    for x, y, s in zip(a.tolist(), b.tolist(), sim.tolist()):
        near.setdefault(x, {})[y] = s
        near.setdefault(y, {})[x] = s
    size, parent = dict.fromkeys(near, 1), {x: x for x in near}
    heap = [(-s, x, y) for x in near for y, s in near[x].items() if x < y]
    heapq.heapify(heap)
    while heap:
        s, x, y = heapq.heappop(heap)
        if -s < least:
            break
        if x not in near or y not in near.get(x, {}) or abs(near[x][y] / (size[x] * size[y]) + s) > 1e-12:
            continue
        gone = near.pop(y)
        near[x].pop(y)
        size[x] += size.pop(y)
        parent[y] = x
        for z, t in gone.items():
            if z != x:
                near[z].pop(y)
                near[x][z] = near[z][x] = near[x].get(z, 0.0) + t
        for z, t in near[x].items():
            heapq.heappush(heap, (-t / (size[x] * size[z]), min(x, z), max(x, z)))
    out = {}
    for x in parent:
        r = x
        while parent[r] != r:
            r = parent[r]
        out[x] = r
    return out


def linkage_rounds(links: DataFrame, least: float) -> DataFrame:
    """(id, cluster) as `average_linkage` gives them, for members of any number: in each round every two clusters that are each
    other's best are joined. The mean of a joined cluster to a third is never above the better of its parts', so pairs that
    are each other's best stay so, and joining them at once gives the clusters that joining the best pair first gives."""
    sums = cut(links.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("sim").alias("s")))
    member = cut(sums.select(F.explode(F.array("x", "y")).alias("id")).distinct().select("id", F.col("id").alias("cluster")))
    for n in itertools.count(1):
        size = member.groupBy("cluster").agg(F.count("*").alias("size"))
        of = lambda c: size.select(F.col("cluster").alias(c), F.col("size").alias(f"size_{c}"))
        mean = sums.join(of("x"), "x").join(of("y"), "y").select("x", "y", (F.col("s") / (F.col("size_x") * F.col("size_y"))).alias("m")).where(F.col("m") >= least)
        choice = mean.select(F.explode(F.array("x", "y")).alias("of"), F.struct((-F.col("m")).alias("m"), "x", "y").alias("pair")).groupBy("of").agg(F.min("pair").alias("pair"))
        joined = cut(choice.groupBy("pair.x", "pair.y").agg(F.count("*").alias("k")).where("k = 2").select("x", "y"))
        if joined.isEmpty():
            return member
        goes = lambda c: joined.select(F.col("y").alias(c), F.col("x").alias(f"to_{c}"))
        member = cut(member.join(goes("cluster"), "cluster", "left").select("id", F.coalesce("to_cluster", "cluster").alias("cluster")))
        moved = sums.join(goes("x"), "x", "left").join(goes("y"), "y", "left").select(F.coalesce("to_x", "x").alias("x"), F.coalesce("to_y", "y").alias("y"), "s")
        sums = cut(moved.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("s").alias("s")))
        if n % 8 == 0:
            member, sums = unsized(member), unsized(sums)


def same_names(df: DataFrame, column: str, link: float = 0.22, least: float = 0.2, spellings: int = 13, share: float = 0.002, top_n: int = 64, in_one: int = 20_000) -> DataFrame:
    """(a, b): each pair of distinct spellings of `column` that name the same company or person, the smaller by bytes first.

    Null, empty and blank values and entries that name nobody have no pairs. Spellings are exact strings: such that
    differ only in case or blanks are pairs. `link` is the cosine from which pairs are looked at, `least` the mean
    cosine down to which clusters are joined; a pair that contradicts itself counts -1. Words of at least `spellings` names
    and of a `share` of all are common if they stand beside many different words. `top_n` bounds the weaker evidence taken
    for a spelling, never its links. Components of more than `in_one` readings are clustered in rounds over the cluster, smaller
    ones each by one task; the clusters are the same. Spellings of equal reading are one vector, so the join depends on the distinct readings.
    """
    names = df.select(F.col(column).alias("name")).where(F.col("name").rlike(r"\S")).distinct()
    worded = cut(read_as(names))
    read = cut(readings(worded, common_words(worded, spellings, share)))
    texts = cut(read.select("telling").distinct().withColumn("id", F.monotonically_increasing_id()))
    nodes = cut(read.select("telling", "others").distinct().join(texts.withColumnRenamed("id", "text"), "telling").withColumn("id", F.monotonically_increasing_id()))
    near = cosine_links(cut(weighted(texts)), link)
    same = texts.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    side = lambda x: nodes.select(F.col("text").alias(x), F.col("id").alias(f"id_{x}"), F.col("telling").alias(f"telling_{x}"), F.col("others").alias(f"others_{x}"))
    pairs = near.unionByName(same).join(side("a"), "a").join(side("b"), "b").where("a <> b OR id_a < id_b")
    low, high = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
    links = cut(judged_links(pairs.select(low.alias("a"), high.alias("b"), "sim", "telling_a", "others_a", "telling_b", "others_b")))
    label = components(links.where("strong"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        found = average_linkage(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["sim"].to_numpy(), least)
        return pd.DataFrame({"id": found.keys(), "cluster": found.values()}, dtype="int64")

    within = links.join(label.withColumnRenamed("id", "a"), "a").join(label.toDF("b", "other"), "b").where("component = other").drop("other")
    evidence = best_links(within, top_n)
    large = cut(label.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > in_one).select("component"))
    clusters = evidence.join(large, "component", "left_anti").groupBy("component").applyInPandas(group, "id bigint, cluster bigint")
    if not large.isEmpty():
        clusters = clusters.unionByName(linkage_rounds(evidence.join(large, "component", "left_semi"), least))
    placed = nodes.join(clusters, "id", "left").select("telling", "others", F.coalesce("cluster", "id").alias("cluster"))
    named = cut(read.join(placed, ["telling", "others"]).select("name", "cluster"))
    other = named.select("cluster", F.col("name").alias("b"))
    return named.select("cluster", F.col("name").alias("a")).join(other, "cluster").where("a < b").select("a", "b")
