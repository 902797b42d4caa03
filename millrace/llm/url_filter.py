"""URL filter: rules by host and path, and for other URLs naive Bayes over the words in host and path.

Names run words together (``cheappills``), so each distinct run of letters is split by a
unigram Viterbi: its substrings meet the words of the pages' texts in a join, and the
split of most probability is taken, with unknown letters as words of their own. A multinomial naive Bayes over these
words then scores each URL.

Nothing is labelled in a crawl. Examples to block are the URLs with a word of a short list
(``BLOCK_WORDS``, a parameter); all others are examples to allow. The model finds what goes with those words, such as
a site's other names.

Counts of words are over all rows, by Spark. Keys of more than a thousandth of the rows of a join, which
are at most a thousand, are joined by broadcast and the rest by shuffle, so that a name in every URL is no hot group.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored

# The rules asked for, and words of sites that corpora usually leave out.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
BLOCK_WORDS = (
    "ads adserver adult banner bet bets betting casino escort gambling jackpot pills poker porn sex slots spam sexy "
    "tracker viagra warez xxx"
).split()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of the list counts as often as this in the dictionary, beside its own count.
LISTED = 100
#: Longest word that a name is split into.
LONGEST = 24
_HOT = 1000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path); both empty for a null, or where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.greatest(F.length(rest), F.lit(1))), "^[^?#]*", 0)
    path = F.when(F.substring(rest, F.length(host) + 1, F.lit(1)) == "/", path).otherwise(F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain, with a path that starts as the rule's."""
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        of, _, start = rule.partition("/")
        found.append(F.when(((host == of) | host.endswith("." + of)) & path.startswith("/" + start), F.lit(rule)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def hot_keys(left: DataFrame, key: str) -> list[str]:
    """Keys of more than a thousandth of the rows: fewer than a thousand."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = left.count()
    return [r[0] for r in counts.where(F.col("n") * _HOT > total).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: list[str]) -> DataFrame:
    """Inner join with a right side of one row a key; rows of hot keys stay where they are."""
    rest = ~F.col(key).isin(hot) if hot else F.lit(True)
    out = left.where(rest).join(right.where(rest), key)
    if hot:
        out = out.unionByName(left.where(F.col(key).isin(hot)).join(F.broadcast(right.where(F.col(key).isin(hot))), key))
    return out


def word_counts(pages: DataFrame, block_words: list[str]) -> DataFrame:
    """word, n: the words of all pages' texts (letters between white space or punctuation, without tags), and the list's."""
    text = F.regexp_replace(F.lower("html"), r"<[^>]*+>", " ")
    alone = r"(?<!\S)\p{P}*+(\p{L}++)\p{P}*+(?!\S)"  # so no part of a host name
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(alone), F.lit(1))).alias("word")).where(F.length("word") <= LONGEST)
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    listed = pages.sparkSession.createDataFrame([(w, LISTED) for w in block_words], "word string, n long")
    return words.unionByName(listed).groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") > 1)


def split_name(name: str, words: list[tuple[int, int, int]], total: int) -> list[str]:
    """The most probable split; ``words``: (start, length, count) of the words found in it.

    An unknown run of letters has the probability of a word never seen, and a 26th for each letter.
    Of equal splits the one with the longer last word, and with a known one, is taken.
    """
    n, letter = len(name), math.log(26)
    ends: dict[int, list[tuple[int, int]]] = {}
    for start, size, count in sorted(words):
        ends.setdefault(start + size, []).append((start, count))
    best, unknown = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1)
    back, run = [0] * (n + 1), [0] * (n + 1)  # where the last word starts
    for i in range(1, n + 1):
        if best[i - 1] - math.log(total) > unknown[i - 1]:
            unknown[i], run[i] = best[i - 1] - math.log(total) - letter, i - 1
        else:
            unknown[i], run[i] = unknown[i - 1] - letter, run[i - 1]
        for start, count in ends.get(i, ()):
            score = best[start] + math.log(count / total)
            if score > best[i]:
                best[i], back[i] = score, start
        if unknown[i] > best[i]:
            best[i], back[i] = unknown[i], run[i]
    out = []
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


def split_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """name, tokens of each distinct name."""
    total = words.agg(F.sum("n")).first()[0] or 1
    size = F.length("name")
    starts = names.select("name", F.explode(F.sequence(F.lit(1), size)).alias("start")).where(F.col("start") < size)
    pieces = starts.select("name", "start", F.explode(F.sequence(F.lit(2), F.least(F.lit(LONGEST), size - F.col("start") + 1))).alias("size"))
    pieces = pieces.withColumn("word", F.substring("name", F.col("start"), F.col("size")))
    found = spread_join(pieces, words, "word", hot_keys(pieces, "word")).groupBy("name").agg(F.collect_list(F.struct((F.col("start") - 1).alias("start"), "size", "n")).alias("words"))

    def split(batches):
        for batch in batches:
            tokens = [split_name(name, [(w["start"], w["size"], w["n"]) for w in words or ()], total) for name, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string()))], ["name", "tokens"])

    return names.join(found, "name", "left").select("name", "words").mapInArrow(split, "name string, tokens array<string>")


def judge(pages: DataFrame, rules: dict[str, str] = RULES, block_words: list[str] = BLOCK_WORDS, alpha: float = 1.0) -> DataFrame:
    """Verdict on every page's URL: page_id, host, path, rule (the longest that fits, or null), verdict, score.

    ``score`` is the log odds of block in millionths, of the model alone; it decides (block above 0) where no rule fits. ``alpha`` is added to each count of a word and class.

    Defined cases: a null url, or one without ``://``, has an empty host and path and the score of no words (the classes' odds, which are below 0 where
    less than half of all URLs are examples to block); null and empty html adds no words; without an example to block
    all scores are null and URLs without a rule are allowed; digits and signs are no words; every row has its own result, so repeated rows and ids
    count each; null ids stay null; no rows give none; extra columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()))
    letters = F.regexp_extract_all(F.lower(F.concat_ws("/", "host", "path")), F.lit(r"\p{L}+"), F.lit(0))
    held = stored(rows.select("uid", F.explode(letters).alias("name")))
    hot = hot_keys(held, "name")
    words = stored(word_counts(pages, block_words))
    names = stored(split_names(held.select("name").distinct(), words))

    listed = names.select("name", F.arrays_overlap("tokens", F.array(*map(F.lit, block_words or [""]))).cast("int").alias("listed"))
    marked = spread_join(held, listed, "name", hot).withColumn("block", F.max("listed").over(Window.partitionBy("uid")))
    marked = stored(marked.select("uid", "name", "block"))
    by_name = marked.groupBy("name").agg(F.sum("block").alias("block"), F.count(F.lit(1)).alias("n"))
    by_word = by_name.join(names, "name").select(F.explode("tokens").alias("word"), "block", "n").groupBy("word").agg(F.sum("block").alias("block"), F.sum("n").alias("n"))
    by_word = stored(by_word)
    blocked = marked.where("block = 1").select("uid").distinct().count()
    n_block, n_all, n_words = by_word.agg(F.sum("block"), F.sum("n"), F.count(F.lit(1))).first()
    if not blocked:
        scored = rows.withColumn("score", F.lit(None).cast("long"))
    else:
        share = lambda part, whole: (part + F.lit(alpha)) / F.lit(whole + alpha * n_words)
        odds = F.log(share(F.col("block"), n_block) / share(F.col("n") - F.col("block"), n_all - n_block))
        by_word = by_word.select("word", F.round(odds * 1e6).cast("long").alias("odds"))  # whole numbers, so sums are the same in any order
        tokens = names.select("name", F.explode("tokens").alias("word"))
        by_name = stored(spread_join(tokens, by_word, "word", hot_keys(tokens, "word")).groupBy("name").agg(F.sum("odds").alias("odds")))
        sums = spread_join(held, by_name, "name", hot).groupBy("uid").agg(F.sum("odds").alias("odds"))
        prior = round(1e6 * math.log((blocked + 1) / (rows.count() - blocked + 1)))
        scored = rows.join(sums, "uid", "left").withColumn("score", F.coalesce("odds", F.lit(0)) + F.lit(prior).cast("long"))
    actions = F.coalesce(*[F.when(F.col("rule") == r, F.lit(a)) for r, a in rules.items()], F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", actions.alias("verdict"), "score")
