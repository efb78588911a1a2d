"""URL filters: prefix rules by host and path, and a naive Bayes verdict over segmented names.

A rule names a host with all its subdomains and a path prefix; the longest that fits decides.
Where none fits, the host's concatenated names are split into words by a unigram Viterbi, and
multinomial naive Bayes scores those words together with the path's.

Both learn from the tables. Unigrams are counted in Spark over all words of a corpus and of
the urls' paths; only those that occur within a name are needed, so they are joined with the
names' substrings and never collected. Class counts come from urls on which a rule decides, a
bounded sample of those outside the held-out fold, and from lists of example words.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule
and is allowed (it has no word, and the prior allows); repeated urls are judged alike and
learned once; a name of more than 63 letters, which no host can have, is one word; digits say
only how many they are; a null text of the corpus has no words; without a corpus names aren't
split. Other columns pass through, except those named like an output, which are replaced. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.sources.shared import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters or of digits, as Spark's regular expressions have them.
_RUNS = r"\p{L}+|\p{Nd}+"
#: Fixed value: letters of a host's longest possible name.
NAME_LETTERS = 63
#: Letters of the longest word that is looked for within a name (a name as a whole is one at any length).
WORD_LETTERS = 24
#: Distinct rule-decided urls of each verdict that class counts are drawn from at most: those with the smallest hashes.
PER_CLASS = 20_000
#: Urls whose hash is 0 modulo this are held out.
FOLDS = 5

#: Example words of both classes beside what the rules teach: parameters of ``learn_classes``.
BLOCKED = (
    "cheap pills", "buy cheap meds online", "online pharmacy viagra cialis", "casino win", "online casino slots jackpot", "poker bonus win", "free bets", "sports betting bets odds bonus",
    "spam farm", "link farm seo backlinks", "ads track", "ad server tracker click ads", "pixel track banner ads", "xxx adult cams", "porn tube free sex", "hot singles dating adult",
    "payday loans fast cash", "easy money win cash", "free download crack keygen warez", "torrent pirate free movies", "lottery win prize", "replica watches cheap", "weight loss pills miracle", "click bait free gift win",
)
ALLOWED = (
    "news world today", "daily times news", "blog personal notes", "science research journal", "university library", "open source docs", "wiki encyclopedia", "health clinic care", "city council",
    "school education learning", "history museum art", "travel guide", "food recipes kitchen", "weather report", "garden home", "software engineering blog", "music review", "book review magazine",
    "sports club news", "local community forum", "bank of the river", "photo gallery", "government service", "support help center",
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; then up to "?", "#" or the end."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, pattern, 1), _UPPER, _LOWER), F.regexp_extract(whole, pattern, 2)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host, slash + path, verdict == "allow")

    def __str__(self) -> str:
        return self.host + self.path


def fitting_rule(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; of equally long ones the first by name."""
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(str(r)), str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.lit(str(r)), F.lit("allow" if r.allow else "block")
        rule, verdict = (F.when(fits, x) if so_far is None else so_far.when(fits, x) for so_far, x in zip((rule, verdict), found, strict=True))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split of a concatenated name.

    A word is worth log(count / total); a stretch that is no word as much as a word that was
    never seen, less 3 for each letter.
    """
    n = len(name)
    best = [0.0] + [-math.inf] * n
    cut = [0] * (n + 1)
    unseen = -math.log(total + 1)
    for j in range(1, n + 1):
        for i in range(j):
            seen = counts.get(name[i:j])
            score = best[i] + (math.log(seen / (total + 1)) if seen else unseen - 3.0 * (j - i))
            if score > best[j]:
                best[j], cut[j] = score, i
    words: list[str] = []
    while n:
        words.append(name[cut[n] : n])
        n = cut[n]
    return words[::-1]


def runs(text: Column) -> Column:
    """Lower-case runs of letters, and runs of digits as their length."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(_RUNS), F.lit(0)), lambda w: F.when(w.rlike(r"^\p{Nd}"), F.concat(F.lit("#"), F.length(w).cast("string"))).otherwise(w))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over the rows' letters; counted by blank-separated token first, which combines before any shuffle."""
    text = F.col(f"`{texts.columns[0]}`")
    tokens = texts.select(F.explode(F.split(F.translate(text, "\t\n\r", "   "), " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    words = tokens.select(F.explode(F.regexp_extract_all(F.lower("token"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"), "n")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def segmented_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) of each distinct name, by the counts (word, n)."""
    total = words.agg(F.sum("n")).first()[0] or 0
    size = F.length("name")
    places = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(WORD_LETTERS), size - i + 1)), lambda k: F.substring(F.col("name"), i, k)))
    parts = names.filter((size > 0) & (size <= NAME_LETTERS)).select("name", F.explode(F.array_distinct(F.concat(F.flatten(places), F.array("name")))).alias("word"))
    # a name has no more parts than places and lengths
    known = parts.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.arrow_udf("array<string>")
    def split(names: pa.Array, known: pa.Array) -> pa.Array:
        return pa.array([segment(name, {k["word"]: k["n"] for k in found or ()}, total) for name, found in zip(names.to_pylist(), known.to_pylist(), strict=True)], pa.list_(pa.string()))

    return names.join(known, "name", "left").select("name", F.when(size <= NAME_LETTERS, split("name", "known")).otherwise(F.array("name")).alias("words"))


def host_words(hosts: DataFrame, words: DataFrame | None) -> DataFrame:
    """(host, words) of distinct hosts: their runs of letters split by the counts ``words``, in order; the last is no name."""
    placed = hosts.select("host", runs(F.col("host")).alias("runs")).select("host", F.size("runs").alias("n"), F.posexplode("runs").alias("at", "name"))
    if words is None:
        split = placed.withColumn("words", F.array("name"))
    else:
        named = ~F.col("name").startswith("#") & (F.col("at") < F.col("n") - 1)
        names = placed.filter(named).select("name").distinct()
        split = placed.join(segmented_names(names, words), "name", "left").withColumn("words", F.when(named, F.col("words")).otherwise(F.array("name")))
    # a host's names are as few as its letters
    return split.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))


@dataclass
class UrlModel:
    """Word counts per class for multinomial naive Bayes."""

    allowed: Counter = field(default_factory=Counter)
    blocked: Counter = field(default_factory=Counter)
    #: of being blocked: below a half, so that a url that says nothing is allowed
    prior: float = 0.35

    def __post_init__(self) -> None:
        vocabulary = self.allowed.keys() | self.blocked.keys()
        of_allowed, of_blocked = (math.log(sum(c.values()) + len(vocabulary)) if vocabulary else 0.0 for c in (self.allowed, self.blocked))
        self.odds = {w: math.log(self.blocked[w] + 1) - of_blocked - math.log(self.allowed[w] + 1) + of_allowed for w in vocabulary}
        self.bias = math.log(self.prior / (1 - self.prior))

    def block_probability(self, words: Iterable[str]) -> float:
        """A word of neither class says nothing."""
        odds = self.bias + sum(self.odds.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def learn_classes(judged: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS, allowed: Iterable[str] = ALLOWED, blocked: Iterable[str] = BLOCKED, prior: float = 0.35) -> UrlModel:
    """judged: host, path, words, verdict (null where no rule decides)."""
    key = F.xxhash64("host", "path")
    urls = judged.filter(F.col("verdict").isNotNull() & (F.pmod(key, F.lit(folds)) != 0)).groupBy("host", "path").agg(F.first("verdict").alias("verdict"), F.first("words").alias("words"))
    counts = []
    for verdict, examples in (("allow", allowed), ("block", blocked)):
        drawn = urls.filter(F.col("verdict") == verdict).orderBy(F.xxhash64("host", "path"), "host", "path").limit(per_class)
        rows = drawn.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
        counts.append(Counter({r["w"]: r["n"] for r in rows}) + Counter(w for e in examples for w in re.findall(r"[^\W\d_]+", e.lower())))
    return UrlModel(*counts, prior)


def _scored(words: Column, model: UrlModel) -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.block_probability(w) for w in batch.to_pylist()], pa.float64())

    return score(words)


def filter_urls(df: DataFrame, rules: Iterable[Rule], corpus: DataFrame | None = None, model: UrlModel | None = None, url: str = "url", threshold: float = 0.5, **learning) -> DataFrame:
    """``df`` with host, path, rule, words, block_probability, held_out and verdict (allow or block).

    corpus: one column of texts, whose words split concatenated names. ``learning`` goes to ``learn_classes``.
    """
    outputs = ("host", "path", "rule", "words", "block_probability", "held_out", "verdict")
    own = [c for c in df.columns if c not in outputs]
    host, path = split_url(F.col(f"`{url}`"))
    rows = df.select(host.alias("host"), path.alias("path"), F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own))).alias("row"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), list(rules))
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    words = None
    if corpus is not None:
        words = materialize(count_words(corpus.select(F.col(f"`{corpus.columns[0]}`").alias("text")).union(rows.select("path"))), "url-unigrams")
    known = materialize(host_words(rows.select("host").distinct(), words), "host-words")
    told = F.concat(F.coalesce("words", F.array().cast("array<string>")), runs(F.col("path")))
    rows = rows.join(known, "host", "left").withColumn("words", told)
    if model is None:
        model = learn_classes(rows.select("host", "path", "words", F.col("ruled").alias("verdict")), **learning)
    folds = learning.get("folds", FOLDS)
    rows = rows.withColumn("p", _scored(F.col("words"), model))
    made = {
        "host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "words": F.col("words"), "block_probability": F.col("p"), "held_out": F.pmod(F.xxhash64("host", "path"), F.lit(folds)) == 0,
        "verdict": F.coalesce("ruled", F.when(F.col("p") >= threshold, "block").otherwise("allow")),
    }
    return rows.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(own)), *(made[c].alias(c) for c in outputs))
