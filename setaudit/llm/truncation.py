"""Texts cut off by field limits or lost transfers (problem 8), in SQL.

Word trigrams are counted inside texts and at ends. Words are tokens, names, numbers and checksums by their shape, so the
counts speak for forms of sentences rather than for single names. A trigram ends where the text, a sentence or a line
ends behind it. The final trigram of each text, taken before any mark of omission, is joined to the counts: a text is
cut where its final trigram is frequent inside texts but almost never ends, or, where its last word is a piece, where it is the
beginning of such a trigram. These two rules carry the result. Additions for what they cannot tell: where the trigram is too
rare, its last two words are asked, then its first two (how often does anything end one word later); a last word that no
text has inside but which begins a very frequent word is a piece of that word; a text that ends in a replacement character
lost the bytes behind it; and where many texts of a source share its greatest length, that is a field limit, and a text of
that length is cut unless a sentence ends there.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setaudit.session import cut, spread

# What ends a sentence or line, a sentence only; marks of omission and strays that may follow a cut; words; checksums, whole or
# broken off at the end of a text.
LOST = r"\x{FFFD}\s*$"
STOPS = r"^([.!?。！？…)\]}\"”»*]|[^\p{L}\p{M}\p{N}\p{P}\s])"
FULL = r"^[.!?。！？…]"
OMISSION = r"(\s|\[(\.\.\.|…)\]|\((\.\.\.|…)\)|\.\.\.+|…|\x{FFFD}|[\\|¶\x00-\x1f])+$"
MAY_OMIT = r"[\s\])…\x{FFFD}\\|¶\x00-\x1f]"
TOKEN = r"\n+|\p{IsLatin}[\p{IsLatin}\p{M}'’]*|\p{IsCyrillic}+|[\p{L}\p{M}&&[^\p{IsLatin}\p{IsCyrillic}]]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"
WIDE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
SUM = r"(?<![\p{L}\p{N}])((?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{8}(?![\p{L}\p{N}])|(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{2,7}$)"


def _q(x: str) -> str:
    return "r'" + x.replace("'", "\\x27") + "'"


# Tokens that begin with a small ASCII letter are never shaped and never a stop, those with a capital one never a stop: the
# comparisons spare the patterns for the rest.
SHAPED = f"""
WITH d AS (
  SELECT id, source, n, md5(text) AS same, contains(text, '\\ufffd') AND regexp_like(text, {_q(LOST)}) AS broken, 
         CASE WHEN right(text, 1) RLIKE {_q(MAY_OMIT)} OR right(text, 3) = '...' THEN regexp_replace(text, {_q(OMISSION)}, '') ELSE text END AS body FROM texts WHERE text IS NOT NULL),
-- a lateral view, so the words are made once for all that asks about them
short AS (
  SELECT * FROM d LATERAL VIEW explode(array(concat(array('^', '^'),
    regexp_extract_all(translate(regexp_replace(regexp_replace(regexp_replace(body, {_q(SUM)}, '\\ue000'), r'\\p{{N}}+', '0'), r'\\n+', ' / '), '\\ue000', '8'), {_q(TOKEN)}, 0)))) made AS w
  WHERE size(w) > 2)
SELECT id, source, n, same, broken, body, w, transform(w, (x, i) -> CASE
    WHEN (x >= 'a' AND x < '{{') OR x < 'A' THEN x
    WHEN x RLIKE r'^\\p{{Lu}}\\p{{Lu}}+$' THEN 'XX' WHEN x RLIKE r'^\\p{{Lu}}' AND NOT (i < 3 OR w[i - 1] = '/' OR w[i - 1] RLIKE {_q(FULL)}) THEN 'Xx' ELSE x END) AS t FROM short
"""

# Every trigram with its last word as written, in one pass over the texts. Inside a text: how often it stands there, and how
# often a sentence or line ends behind it. At the end: one row per text, with what is asked about it (`f`). A text is long
# enough to be no title by its tokens or by its characters; one of kana or kanji counts for two.
SPOTS = f"""
WITH g AS (
  SELECT explode(transform(sequence(0, size(t) - 3), i -> struct(
      xxhash64(p[i], t[i + 2]) AS three, p[i + 1] AS pair, p[i] AS two, w[i + 2] AS word,
      CASE WHEN i = size(t) - 3 THEN struct(id, source, n, same, broken, t[i + 2] AS shape, size(t) > 9 OR char_length(regexp_replace(trim(body), {_q(WIDE)}, 'xx')) >= 24 AS long) END AS f,
      CASE WHEN i < size(t) - 3 THEN int(CASE WHEN (t[i + 3] >= 'a' AND t[i + 3] < '{{') OR (t[i + 3] >= 'A' AND t[i + 3] < '[') THEN false ELSE t[i + 3] = '/' OR t[i + 3] RLIKE {_q(STOPS)} END) END AS ends))) AS g
  FROM shaped LATERAL VIEW explode(array(transform(sequence(0, size(t) - 2), i -> xxhash64(t[i], t[i + 1])))) made AS p)
SELECT g.three, g.pair, g.two, g.word, g.f, count(*) AS inside, sum(g.ends) AS ends FROM g GROUP BY g.three, g.pair, g.two, g.word, g.f
"""

DECISION = f"""
WITH
counts AS (SELECT three, pair, two, word, inside, ends FROM spots WHERE f IS NULL),
-- one row per text; a repeated row is in `inside`
finals AS (SELECT three, pair, two, word, f.*, explode(sequence(1, inside)) AS nth FROM spots WHERE f IS NOT NULL),
-- a text counts once as an end, however often it was delivered: copies of a cut text are no evidence that texts end there
seen AS (
  SELECT three, pair, two, inside, ends, 0 AS final FROM counts
  UNION ALL SELECT three, pair, two, 0, 0, 1 FROM (SELECT same, first(three) AS three, first(pair) AS pair, first(two) AS two FROM finals GROUP BY same)),
c3 AS (SELECT three, sum(inside) AS n3, sum(ends) AS s3, sum(final) AS f3 FROM seen GROUP BY three),
cp AS (SELECT pair, sum(inside) AS np, sum(ends) AS sp, sum(final) AS fp FROM seen GROUP BY pair),
c2 AS (SELECT two, sum(inside) AS n2, sum(ends) AS s2, sum(final) AS f2 FROM seen GROUP BY two),
-- pieces of words: beginnings of the frequent continuations of two words, and of the very frequent words of all texts
here AS (SELECT two, word, sum(inside) AS inside FROM counts GROUP BY two, word),
pieces AS (
  SELECT two, piece AS word, sum(inside) AS whole
  FROM (SELECT two, inside, explode(transform(sequence(1, char_length(word) - 1), i -> substring(word, 1, i))) AS piece FROM here WHERE inside >= {{support}} AND word RLIKE r'^\\p{{L}}\\p{{L}}')
  GROUP BY two, piece),
words AS (SELECT word, sum(inside) AS nw FROM counts WHERE word RLIKE r'^\\p{{L}}' GROUP BY word),
starts AS (
  SELECT piece AS word, sum(nw) AS begins
  FROM (SELECT nw, explode(transform(sequence(1, char_length(word) - 1), i -> substring(word, 1, i))) AS piece FROM words WHERE char_length(word) > 1 AND nw >= 0.02 * (SELECT count(*) FROM finals))
  GROUP BY piece),
-- field limits: the greatest length of a source, where at least 2 in 100 of its texts, and three different ones, have it
most AS (SELECT source, max(n) AS n, count(*) AS k FROM finals GROUP BY source),
limits AS (
  SELECT m.source, m.n FROM most m JOIN finals s ON s.source = m.source AND s.n = m.n
  GROUP BY m.source, m.n, m.k HAVING count(DISTINCT s.same) >= 3 AND count(*) >= 0.02 * m.k),
-- each final trigram with its last word is asked once, however many texts end on it
asked AS (SELECT DISTINCT three, pair, two, word FROM finals),
told AS (
  SELECT l.three, l.word, coalesce(n3, 0) + f3 - 1 AS a3, coalesce(s3, 0) + f3 - 1 AS e3, coalesce(np, 0) + fp - 1 AS ap, coalesce(sp, 0) + fp - 1 AS ep,
         coalesce(n2, 0) + f2 - 1 AS a2, coalesce(s2, 0) + f2 - 1 AS e2, coalesce(h.inside, 0) AS word_here, coalesce(p.whole, 0) AS piece_here,
         coalesce(nw, 0) AS word_ever, coalesce(begins, 0) AS piece_ever
  FROM asked l
  LEFT JOIN c3 ON l.three = c3.three LEFT JOIN cp ON l.pair = cp.pair LEFT JOIN c2 ON l.two = c2.two
  LEFT JOIN here h ON l.two = h.two AND l.word = h.word LEFT JOIN pieces p ON l.two = p.two AND l.word = p.word
  LEFT JOIN words v ON l.word = v.word LEFT JOIN starts b ON l.word = b.word),
each AS (
  SELECT l.*, t.* EXCEPT (three, word), k.n IS NOT NULL AS at_limit, l.shape RLIKE {_q(STOPS)} AS stopped, l.shape RLIKE {_q(FULL)} AS full
  FROM finals l JOIN told t ON l.three = t.three AND l.word = t.word LEFT JOIN limits k ON l.source = k.source AND l.n = k.n)
SELECT id, source, CASE
    WHEN NOT full AND long AND a3 >= {{support}} AND e3 <= {{rate}} * a3 THEN 'trigram'
    WHEN NOT full AND long AND NOT stopped AND piece_here > 0 AND word_here <= {{rate}} * piece_here AND (a3 < {{support}} OR e3 < 0.5 * a3) THEN 'piece'
    WHEN NOT full AND long AND NOT stopped AND a3 < {{support}} AND ap >= {{support}} AND ep <= {{rate}} * ap THEN 'pair'
    WHEN NOT full AND long AND NOT stopped AND a3 < {{support}} AND ap < {{support}} AND a2 >= {{support}} AND e2 <= {{rate}} * a2 THEN 'pair'
    WHEN NOT full AND long AND NOT stopped AND word_ever = 0 AND piece_ever > 0 AND (a3 < {{support}} OR e3 < 0.5 * a3) THEN 'word'
    WHEN broken AND NOT full THEN 'lost'
    WHEN at_limit AND NOT stopped THEN 'limit'
  END AS cut_in
FROM each
"""


def _over(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """The SQL over frames by name. Their views bear names of their own and are gone afterwards, so none of the session's is shadowed."""
    mark = uuid.uuid4().hex
    for name, frame in frames.items():
        frame.createOrReplaceTempView(f"{name}_{mark}")
        sql = re.sub(rf"\bFROM {name}\b", f"FROM {name}_{mark}", sql)
    try:
        return spark.sql(sql)
    finally:
        for name in frames:
            spark.catalog.dropTempView(f"{name}_{mark}")


def judged(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", support: int = 8, rate: float = 0.02) -> DataFrame:
    """(key, source, cut_in): one row per non-null text that has any words; `cut_in` is null for texts that end as meant,
    else the first rule that tells: trigram (the final trigram), piece (the final trigram with the last word as the
    beginning of one), pair (two words, where the trigram is too rare), word (the last word as the beginning of a very
    frequent one), lost (a replacement character at the end), limit (the source's greatest length).

    `support`: from how many occurrences on a trigram can tell. `rate`: up to what share of its occurrences ending it
    almost never ends; the text asked about is left out, with all its copies. Null, empty and blank texts have no row.
    Insides of repeated rows are counted as they are, ends once per distinct text. A null source has no field limit. All
    counts are over all texts; texts are read once, and only counts by trigram, pair or word are joined, aggregated within
    each partition first.
    """
    spark = documents.sparkSession
    texts = spread(documents.selectExpr(f"`{key}` AS id", f"`{text}` AS text", f"`{source}` AS source", f"char_length(`{text}`) AS n"))
    spots = cut(_over(spark, SPOTS, shaped=_over(spark, SHAPED, texts=texts)))
    return _over(spark, DECISION.replace("{support}", str(support)).replace("{rate}", str(rate)), spots=spots).withColumnRenamed("id", key)


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id): the documents that were cut off."""
    return judged(documents).where("cut_in IS NOT NULL").select("doc_id")


def truncation_by_source(documents: DataFrame) -> DataFrame:
    """(source, texts, cut, share): how large each source's share of cut texts is."""
    return judged(documents).groupBy("source").agg(F.count("*").alias("texts"), F.count("cut_in").alias("cut"), (F.count("cut_in") / F.count("*")).alias("share"))
