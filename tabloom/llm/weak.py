"""Quality classifier from weak labels: voting heuristics, expectation-maximisation, a hashed linear scorer.

Heuristic labellers vote good, bad or abstain on every document. How often each
combination of votes occurs, over all documents, is enough to estimate by
expectation-maximisation how each labeller votes on good and on bad documents.
The posteriors of a bounded sample train a logistic scorer over hashed words,
word shapes and binned statistics, which then scores every document. A second
set of labellers looks for abusive language; the same estimation, on its own,
gives every document the posterior of being abusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import staged

# Frequent function words of the four languages; a parameter of the labeller, not of the scorer.
FUNCTION_WORDS = ("the of and to in is that for with was on as are by this be at or from "
                  "le la les de des et en un une du que qui dans est pour pas sur au avec "
                  "der die das und ist ein eine zu den mit von im auf des auch sich nicht "
                  "el los las del que en y un una por con para su al se no es").split()
# Common insults and threats of the four languages; parameters of the labellers for abusive language.
INSULTS = ("idiot idiots moron morons imbecile stupid dumb dumbass loser losers scum trash garbage worthless pathetic disgusting clown clowns freak pig bastard "
           "bitch asshole jerk coward filth vermin retard scumbag "
           "idiote crétin crétins débile abruti connard connards salaud ordure racaille pourriture "
           "dummkopf trottel arschloch versager abschaum drecksau vollidiot miststück widerling "
           "idiota imbécil estúpido estúpida gilipollas cabrón escoria basura payaso asqueroso").split()
THREATS = (r"kill (?:you|yourself)|shut up|go die|drop dead|hate you|i will hurt|ta gueule|va mourir|je vais te|halt die (?:klappe|fresse)|verpiss dich|"
           r"ich bring dich|cállate|te voy a|muérete|vete a la mierda")
ADDRESS = r"you|you're|your|tu|toi|vous|du|dich|ihr|tú|eres|usted"
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    sample_docs: int = 12_000  # expected documents the scorer learns from, drawn by a hash of the id
    bits: int = 16  # the scorer has 2**bits weights
    rounds: int = 60  # of expectation-maximisation
    prior_good: float = 0.8
    doubt: float = 6.0  # at the start one vote for bad outweighs twelve for good
    smoothing: float = 1.0
    regularisation: float = 0.002
    threshold: float = 0.5
    abusive: float = 0.5  # documents at or above it are not kept


def words() -> Column:
    """The words of ``__text``."""
    return F.filter(F.split("__text", SPACE), lambda w: w != "")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__words`` (lower-cased) and the statistics the labellers use; a null text counts as empty."""
    filled = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__text", F.lower(filled))
    out = out.withColumn("__words", words())
    n, distinct = F.greatest(F.size("__words"), F.lit(1)), F.array_distinct("__words")
    lines = F.filter(F.split("__text", "\n"), lambda x: F.trim(x) != "")
    length = F.char_length("__text")
    symbols = length - F.char_length(F.translate("__text", "#*$%&|<>", ""))
    stops = F.array(*[F.lit(w) for w in sorted(set(FUNCTION_WORDS))])
    insult = rf"(?<!\p{{L}})(?:{'|'.join(sorted(INSULTS))})(?!\p{{L}})"
    address = rf"(?<!\p{{L}})(?:{ADDRESS})(?:[^\p{{L}}]+\p{{L}}+){{0,2}}[^\p{{L}}]+(?:{'|'.join(sorted(INSULTS))})(?!\p{{L}})"
    out = out.withColumn("__insults", F.regexp_extract_all("__text", F.lit(insult), F.lit(0)))
    return out.withColumns({
        "__n": F.size("__words"),
        "__abuse": F.size("__insults"),
        "__abuses": F.size(F.array_distinct("__insults")),
        "__address": (F.size("__insults") > 0) & F.col("__text").rlike(address),
        "__threat": F.col("__text").rlike(rf"(?<!\p{{L}})(?:{THREATS})(?!\p{{L}})"),
        "__distinct": F.size(distinct) / n,
        "__function": F.size(F.array_intersect(distinct, stops)) / F.greatest(F.size(distinct), F.lit(1)) * F.sqrt(n.cast("double")),
        "__symbols": symbols / F.greatest(length, F.lit(1)),
        "__stops": (length - F.char_length(F.translate("__text", ".!?", ""))) / n,
        "__wordlength": length / n,
        "__lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    })


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def labellers() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains."""
    n = F.col("__n")
    return {
        "length": _vote(n >= 60, n < 3),
        "symbols": _vote(F.col("__symbols") < 0.0005, F.col("__symbols") > 0.008),
        # the share of distinct words falls with length: Heaps' law with a wide margin
        "repetition": _vote(F.col("__distinct") > 0.25, F.col("__distinct") < 1.5 / F.sqrt(F.greatest(n, F.lit(9)).cast("double"))),
        "sentences": _vote(F.col("__stops").between(0.02, 0.3), (n >= 40) & ~F.col("__stops").between(0.01, 0.5)),
        "word_length": _vote(F.col("__wordlength").between(4.0, 10.0), ~F.col("__wordlength").between(3.0, 13.0)),
        "function_words": _vote(F.col("__function") > 0.8, (n >= 30) & (F.col("__function") < 0.35)),
        "lines": _vote(F.col("__lines") > 0.9, F.col("__lines") < 0.6),
    }


def abuse_labellers() -> dict[str, Column]:
    """Votes: 1 clean, -1 abusive, 0 abstains."""
    n = F.greatest(F.col("__n"), F.lit(1))
    return {
        "insults": _vote(F.col("__abuse") == 0, F.col("__abuse") >= 2),
        "variety": _vote(F.col("__abuses") == 0, F.col("__abuses") >= 2),
        "density": _vote(F.col("__abuse") == 0, F.col("__abuse") / n > 0.01),
        "address": _vote(F.lit(False), F.col("__address")),
        "threats": _vote(F.lit(False), F.col("__threat")),
    }


@dataclass
class Votes:
    """What each labeller's votes say: log odds of good per labeller and vote, and of good alone."""

    odds: dict[str, dict[int, float]]
    base: float

    def posterior(self) -> Column:
        total = F.lit(self.base)
        for name, by_vote in self.odds.items():
            vote = F.col(f"__vote_{name}")
            total = total + F.when(vote == 1, by_vote[1]).when(vote == -1, by_vote[-1]).otherwise(by_vote[0])
        return 1 / (1 + F.exp(-total))


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: list[str], s: Settings = Settings()) -> Votes:
    """Expectation-maximisation over vote patterns and their counts; starts from the votes, in which bad weighs more."""
    if not patterns:
        return Votes({name: {-1: 0.0, 0: 0.0, 1: 0.0} for name in names}, 0.0)
    votes = np.array([p for p, _ in patterns]) + 1
    counts = np.array([c for _, c in patterns], np.float64)
    start = 0.5 * (votes == 2).sum(axis=1) - s.doubt * (votes == 0).sum(axis=1)
    good = 1 / (1 + np.exp(-start - math.log(s.prior_good / (1 - s.prior_good))))
    for _ in range(s.rounds):
        table = np.zeros((2, len(names), 3))
        for v in range(3):
            hit = votes == v
            table[1, :, v] = (hit * (counts * good)[:, None]).sum(axis=0)
            table[0, :, v] = (hit * (counts * (1 - good))[:, None]).sum(axis=0)
        table = (table + s.smoothing) / (table + s.smoothing).sum(axis=2, keepdims=True)
        share = ((counts * good).sum() + s.smoothing) / (counts.sum() + 2 * s.smoothing)
        odds = np.log(table[1]) - np.log(table[0])
        total = math.log(share / (1 - share)) + odds[np.arange(len(names)), votes].sum(axis=1)
        good = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
    return Votes({name: {v - 1: float(odds[i, v]) for v in range(3)} for i, name in enumerate(names)}, math.log(share / (1 - share)))


BINNED = ("__n", "__distinct", "__function", "__symbols", "__stops", "__wordlength", "__lines")


def _bins(name: str, limits: list[float]) -> Column:
    value = F.col(f"__{name}")
    place = sum((F.when(value > x, 1).otherwise(0) for x in limits), F.lit(0))
    return F.concat(F.lit(f"\t{name}="), place)


def tokens() -> Column:
    """Hashed features: words, shapes of words, and binned statistics (told apart by a leading tab)."""
    shape = F.regexp_replace(F.regexp_replace("__text", r"\p{L}+", "a"), r"[0-9]+", "9")
    shapes = F.transform(F.array_distinct(F.split(shape, SPACE)), lambda x: F.concat(F.lit("\t"), x))
    bins = F.array(
        _bins("n", [9, 19, 39, 79, 159, 639, 2559]), _bins("distinct", [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8]),
        _bins("function", [0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 1.0, 1.3]), _bins("symbols", [0, 0.0005, 0.002, 0.004, 0.008, 0.02, 0.05]),
        _bins("stops", [0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5]), _bins("wordlength", [3, 4, 5, 6, 7, 8, 10, 13]), _bins("lines", [0.3, 0.6, 0.8, 0.9, 0.99]))
    return F.concat(F.array_distinct("__words"), shapes, bins)


def classify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, weak_label (posterior of the votes), score (0 to 1), toxic (0 to 1) and kept for every row of ``docs`` (doc_id, text).

    ``toxic`` is the posterior of the labellers for abusive language; a document is kept if it is good and not abusive. A
    null text counts as empty. Without a document, or with votes that all
    agree, the posterior itself is the score. Equal texts get equal scores.
    """
    named = labellers()
    names, abuse = list(named), abuse_labellers()
    seen = statistics(docs.select("doc_id", "text"))
    votes = {f"__vote_{k}": v for k, v in (named | abuse).items()}
    # The texts are looked through once: what the votes and the scorer take from them is kept, with the lower-cased text.
    voted = staged(seen.select("doc_id", "__text", *BINNED, *[v.alias(k) for k, v in votes.items()]), "votes").withColumn("__words", words())
    counts = voted.groupBy(*[f"__vote_{k}" for k in [*names, *abuse]]).count().collect()  # at most 3 ** labellers rows

    def estimated(first: int, last: int, names: list[str]) -> Votes:
        patterns: dict[tuple, int] = {}
        for r in counts:
            patterns[r[first:last]] = patterns.get(r[first:last], 0) + r[-1]
        return estimate(sorted(patterns.items()), names, s)

    voted = voted.withColumn("weak_label", estimated(0, len(names), names).posterior())
    voted = voted.withColumn("toxic", 1 - estimated(len(names), len(names) + len(abuse), list(abuse)).posterior())
    total = sum(r[-1] for r in counts)
    share = min(1.0, s.sample_docs / max(1, total))
    picked = voted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = picked.select(tokens().alias("tokens"), (F.col("weak_label") > 0.5).cast("double").alias("label"), F.abs(2 * F.col("weak_label") - 1).alias("weight"))
    sample = staged(sample, "weak")
    hashing = HashingTF(inputCol="tokens", outputCol="features", numFeatures=1 << s.bits, binary=True)
    if sample.where("weight > 0").select("label").distinct().count() < 2:
        score = F.col("weak_label")
        scored = voted
    else:
        parts = max(1, min(8, docs.sparkSession.sparkContext.defaultParallelism))
        fit = LogisticRegression(maxIter=25, regParam=s.regularisation, weightCol="weight", standardization=False).fit(hashing.transform(sample.coalesce(parts)))
        slim = voted.select("doc_id", "weak_label", "toxic", tokens().alias("tokens"))
        scored = fit.transform(hashing.transform(slim))
        score = vector_to_array("probability")[1]
    out = scored.select("doc_id", "weak_label", score.alias("score"), "toxic")
    return out.withColumn("kept", (F.col("score") >= s.threshold) & (F.col("toxic") < s.abusive))
