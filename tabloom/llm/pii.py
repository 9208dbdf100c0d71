"""Personal data by boosted trees over generously proposed spans, in DataFrame operations only.

Four fixed formats (email, ip, card, phone) are always found. On top of them,
generators propose every address-like token, every run of digits and every long
token with a digit, overlapping as they may. Gradient-boosted trees score each
proposal from its format and context; a threshold calibrated on held-out
proposals decides. The trees learn from the corpus itself, from evidence: fixed
formats, checksums, credential and contact words speak for personal data, short
or decimal numbers and bare tokens against it, and what neither speaks of has
no label. Work on a text grows with its length, however many spans it holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import without
from tabloom.session import stable

# Fixed formats. Possessive repeats and looking behind keep the search linear and give the same matches.
LOCAL = "A-Za-z0-9._%+-"
FORMATS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
BLANK = r"\x20\x09-\x0D"
PROPOSALS = {
    "address": rf"(?<![^{BLANK}])[^{BLANK}@]*+@[^{BLANK}]*+",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().:/-]{0,3}+[0-9])*+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/=.-]*+[0-9])[A-Za-z0-9_+/=.-]{12,}+",
}
CREDENTIAL = r"(?i)(?:password|passwd|pwd|secret|token|api_?key|access_?key|bearer)[\"']?\s*[=:]\s*[\"']?$"
CREDENTIAL_IN = r"(?i)(?:password|passwd|pwd|secret|token|api_?key|access_?key)[=:]"
CONTACT = r"(?i)(?:mail|tel|phone|fon|call|fax|mobil|card|iban|konto|account|host|addr|ssn|contact)[^0-9A-Za-z]{0,4}$"
ADDRESS = r"^[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+$"
SOCIAL = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
DECIMAL = r"^[0-9]+[.,][0-9]{1,2}$"
KEY_ID = r"^(?:AKIA|ASIA|ghp_|sk_|xox)[0-9A-Za-z_]{12,}$"
FEATURES = ("length", "digits", "upper", "lower", "dots", "dashes", "blanks", "at", "plus", "equals", "groups", "longest", "octets", "luhn", "credential", "contact",
            "before", "after", "hexadecimal")


@dataclass(frozen=True)
class Settings:
    trees: int = 8
    depth: int = 3
    bins: int = 512  # places of a feature at which a tree may split
    held_out: float = 0.3  # share of the proposals that only calibrates
    precision: float = 0.98  # the threshold is the lowest that keeps it on the held-out share
    seed: int = 7


CHUNK = 128  # values of a running sum that are appended one by one
BLOCK = 4096  # code points of a text that are cut out together
SPAN = "array<struct<start:int,end:int,match:string,lead:string,next:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], first: Column) -> Column:
    """The values joined up from the first one on; ``values`` is bound. Chunks are joined first, so the work grows in proportion."""
    empty = F.array().cast("array<int>")

    def walk(start: Column) -> Column:
        return F.struct(start.alias("at"), empty.alias("out"))

    def step(state: Column, v: Column) -> Column:
        return bound(join(state["at"], v), lambda now: F.struct(now.alias("at"), F.concat(state["out"], F.array(now)).alias("out")))

    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")))
    chunks = F.transform(starts, lambda k: F.aggregate(F.slice(values, k * CHUNK + 1, F.lit(CHUNK)), walk(first), step))

    def base(state: Column, chunk: Column) -> Column:
        return F.struct(join(state["at"], chunk["at"]).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    return bound(chunks, lambda c: bound(F.aggregate(c, walk(first), base)["out"], lambda bases: F.flatten(
        F.zip_with(c, bases, lambda chunk, b: F.transform(chunk["out"], lambda v: join(b, v))))))


def total(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


def highest(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), F.lit(-1))


def below(values: Column, limit: Column) -> Column:
    """How many of the rising ``values`` are under ``limit``, by bisection."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(30))])
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.get(values, lo + s - 1) < limit, lo + s).otherwise(lo))


def spans(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches: start, end (code points, exclusive), match, and what stands before and after.

    ``lead`` has up to 24 characters from between this match and the last but one, ``next`` the character behind.
    """

    def located(found: Column, gaps: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m))

        def one(ends: Column, m: Column, i: Column) -> Column:
            blank = lambda c: F.coalesce(c, F.lit(""))
            lead = F.right(F.concat(blank(F.get(gaps, i - 1)), blank(F.get(found, i - 1)), F.get(gaps, i)), F.lit(24))
            return F.struct((F.get(ends, i) - F.char_length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"), lead.alias("lead"),
                            F.left(F.concat(F.get(gaps, i + 1), blank(F.get(found, i + 1))), F.lit(1)).alias("next"))

        return bound(sizes, lambda z: bound(total(z), lambda ends: F.transform(found, lambda m, i: one(ends, m, i))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    out = bound(found, lambda f: F.when(F.size(f) > 0, bound(F.split(text, pattern, -1), lambda gaps: located(f, gaps))))
    return F.coalesce(out, F.array().cast(SPAN)).cast(SPAN)


def _for(kind: str, fn: Callable[[str, Column], Column]) -> Callable[[Column], Column]:
    """``fn`` for one kind, as a function of an array's element."""
    return lambda s: fn(kind, s)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _octet(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(F.when(F.length(bare) <= 3, bare).try_cast("int"), F.lit(0)) <= 255)


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _octet)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "address": "@", "number": "[0-9]", "secret": "[0-9]"}


def _find(kind: str, pattern: str) -> Column:
    return F.when(F.col("text").rlike(NEEDS[kind]), spans(F.col("text"), pattern)).otherwise(F.array().cast(SPAN))


def fixed_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with one array column per fixed format: its valid spans in order."""
    found = docs.withColumns({f"__{k}": _find(k, p) for k, p in FORMATS.items()})
    return found.withColumns({f"__{k}": F.filter(f"__{k}", _for(k, lambda kind, s: _valid(kind, s["match"]))) for k in FORMATS})


def _remainder(digits: Column, by: int) -> Column:
    """Of a number of any length, taken seven digits at a time."""
    return F.aggregate(F.regexp_extract_all(digits, F.lit("[0-9]{1,7}"), F.lit(0)), F.lit(0).cast("long"),
                       lambda rest, part: (F.concat(rest.cast("string"), part).cast("long")) % by)


def _iban(match: Column) -> Column:
    """Whether a token is an account number whose check digits are right."""
    bare = F.upper(F.regexp_replace(match, r"\x20", ""))
    turned = F.concat(F.substring(bare, 5, 40), F.left(bare, F.lit(4)))
    letters = F.array_join(F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.when(bare.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$"), _remainder(letters, 97) == 1).otherwise(F.lit(False))


def _features(s: Column) -> Column:
    """The proposal with its numeric features, and the evidence for (1) or against (0) it, null if there is none."""
    m, d, lead = s["match"], _digits(s["match"]), s["lead"]
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    count = lambda p: F.length(F.regexp_replace(m, f"[^{p}]", ""))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    values = {
        "length": F.length(m), "digits": F.length(d), "upper": count("A-Z"), "lower": count("a-z"), "dots": count("."), "dashes": count("()/:-"),
        "blanks": count(r"\x20"), "at": count("@"), "plus": flag(m.startswith("+")), "equals": count("="), "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
        "octets": F.size(F.filter(F.split(m, r"\."), lambda g: g.rlike("^[0-9]+$") & _octet(g))),
        "luhn": flag(F.length(d).between(12, 19) & F.call_function("luhn_check", d)),
        "credential": flag(lead.rlike(CREDENTIAL) | m.rlike(CREDENTIAL_IN)), "contact": flag(lead.rlike(CONTACT)),
        "before": flag(F.right(lead, F.lit(1)).rlike("[A-Za-z0-9]")), "after": flag(s["next"].rlike("[A-Za-z0-9]")),
        "hexadecimal": flag(m.rlike("^[0-9a-f]{12,}$")),
    }
    number, address = s["kind"] == "number", s["kind"] == "address"
    told = (number & (F.length(d).between(7, 15)) & lead.rlike(CONTACT)) | m.rlike(SOCIAL) & (s["kind"] == "number") | (address & m.rlike(ADDRESS))
    proof = told | lead.rlike(CREDENTIAL) | m.rlike(CREDENTIAL_IN) | m.rlike(KEY_ID) | (F.length(m) >= 15) & _iban(m)
    plain = (number & ((F.length(d) < 7) | m.rlike(DECIMAL))) | (address & ~m.rlike(ADDRESS)) | (s["kind"] == "secret")
    evidence = F.when(s["fixed"] | F.coalesce(proof, F.lit(False)), 1).when(plain, 0)
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["inside"].alias("inside"), evidence.alias("evidence"),
                    *[values[f].cast("double").alias(f) for f in FEATURES])


def proposals(found: DataFrame) -> DataFrame:
    """Adds ``__more``: the proposals with features, evidence, and whether a span of a fixed format holds all of them."""
    named = [F.transform(_find(k, p), _for(k, lambda kind, s: F.struct(*[s[c].alias(c) for c in ("start", "end", "match", "lead", "next")], F.lit(kind).alias("kind"))))
             for k, p in PROPOSALS.items()]
    fixed = F.sort_array(F.concat(*[F.transform(f"__{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in FORMATS]))

    def judged(starts: Column, ends: Column) -> Column:
        """``ends``: the highest end up to each fixed span."""
        reach = lambda n: F.coalesce(F.get(ends, n - 1), F.lit(-1))

        def one(s: Column) -> Column:
            placed = s.withField("fixed", reach(below(starts, s["end"])) > s["start"])
            return _features(placed.withField("inside", reach(below(starts, s["start"] + 1)) >= s["end"]))

        return F.transform(F.concat(*named), one)

    more = bound(fixed, lambda f: bound(F.transform(f, lambda s: s["start"]), lambda starts: bound(
        F.transform(f, lambda s: s["end"]), lambda each: bound(highest(each), lambda ends: judged(starts, ends)))))
    return found.withColumn("__more", more)


@dataclass
class Trees:
    """A boosted model as column expressions, with its threshold."""

    roots: list  # nested (feature, limit, left, right) or leaf values
    weights: list[float]
    threshold: float

    def score(self, s: Column) -> Column:
        """Probability of being personal data."""

        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, limit, left, right = node
            return F.when(s[FEATURES[feature]] <= limit, value(left)).otherwise(value(right))

        margin = F.lit(0.0)
        for root, weight in zip(self.roots, self.weights):
            margin = margin + F.lit(weight) * value(root)
        return 1 / (1 + F.exp(-2 * margin))


def _nested(node):
    """A fitted tree as nested tuples; splits are all numeric."""
    if node.numDescendants() == 0:
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _nested(node.leftChild()), _nested(node.rightChild())


def train(docs: DataFrame, s: Settings = Settings()) -> Trees | None:
    """Fit and calibrate on every proposal with evidence, of all ``docs`` (with texts); None if it is all of one kind.

    Proposals with the same features and evidence are one row that weighs as many as they are.
    """
    rows = proposals(fixed_spans(docs.select("text"))).select(F.xxhash64("text").alias("t"), F.inline("__more")).where("evidence is not null")
    held = F.pmod(F.hash(F.xxhash64("t", "start", "end", "kind")), F.lit(1000)) < int(1000 * s.held_out)
    rows = rows.select(held.alias("held"), F.col("evidence").cast("double").alias("label"), *FEATURES)
    told = stable(rows.groupBy("held", "label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n")))
    if told.where("not held").select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(told.where("not held"))
    model = GBTClassifier(maxIter=s.trees, maxDepth=s.depth, maxBins=s.bins, seed=s.seed, labelCol="label", weightCol="n").fit(vectors)
    trees = Trees([_nested(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees], list(model.treeWeights), 0.5)
    # Calibrate: the lowest threshold whose held-out precision is high enough.
    scored = told.where("held").withColumn("s", F.struct(*FEATURES)).select("label", "n", F.floor(trees.score(F.col("s")) * 100).alias("bin"))
    bins = {r["bin"]: (r["n"], r["hits"]) for r in scored.groupBy("bin").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("hits")).collect()}
    best, n, hits = 0.99, 0, 0.0
    for b in range(100, -1, -1):
        n, hits = n + bins.get(b, (0, 0))[0], hits + bins.get(b, (0, 0.0))[1]
        if n and hits / n >= s.precision:
            best = b / 100
    trees.threshold = max(best, 0.5)  # never below even odds
    return trees


KINDS = (*FORMATS, *PROPOSALS)


def detect(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``pii``: array<struct<kind, start, end>>, by kind as in ``KINDS``, then start.

    All spans of the fixed formats, and the proposals the trees accept that do not lie inside one of them; spans may
    overlap. A null text counts as empty. ``n_fixed`` counts the fixed ones per kind.
    """
    docs = without(docs, ("n_fixed", "base", "pii"))
    filled = docs.withColumn("text", F.coalesce("text", F.lit("")))
    trees = train(filled, s)
    wide = fixed_spans(filled)
    plain = lambda kind, s: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    if trees is None:
        wide = wide.withColumn("__added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    else:
        wide = proposals(wide)
        accepted = F.filter("__more", lambda x: ~x["inside"] & (trees.score(x) >= trees.threshold))
        wide = wide.withColumn("__added", F.transform(accepted, lambda x: plain(x["kind"], x)))  # in the order of the generators, then of the text
    wide = wide.withColumn("__base", F.concat(*[F.transform(f"__{k}", _for(k, plain)) for k in FORMATS]))
    n_fixed = F.struct(*[F.size(f"__{k}").cast("long").alias(k) for k in FORMATS])
    return wide.select(*[F.col(f"`{c}`") for c in docs.columns], n_fixed.alias("n_fixed"), F.col("__base").alias("base"), F.concat("__base", "__added").alias("pii"))


def listed(spans_col: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text given in blocks; ``blocks`` is bound."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    between = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    apart = F.concat(F.substring(block(first), start % BLOCK + 1, F.lit(BLOCK)), between, F.substring(block(last), F.lit(1), end % BLOCK))
    return F.when(first == last, F.substring(block(first), start % BLOCK + 1, end - start)).otherwise(apart)


def redact(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with every found span replaced by its kind in square brackets; spans that meet go as one, named after the first."""
    docs = without(docs, ("n_fixed", "base", "pii"))
    found = detect(docs, s)
    ordered = F.array_sort(F.transform("pii", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def masked(o: Column, ends: Column, blocks: Column) -> Column:
        """``ends``: the highest end up to each span; a span that starts beyond it begins a new gap."""
        fresh = F.filter(F.transform(o, lambda x, i: F.when(x["start"] > F.coalesce(F.get(ends, i - 1), F.lit(-1)), i)), lambda i: i.isNotNull())

        def parts(heads: Column) -> Column:
            reach = lambda k: F.get(ends, F.coalesce(F.get(heads, k + 1), F.size(ends)) - 1)
            each = F.transform(heads, lambda i, k: F.concat(
                cut(blocks, F.coalesce(F.get(ends, i - 1), F.lit(0)), F.get(o, i)["start"]), F.lit("["), F.upper(F.get(o, i)["kind"]), F.lit("]"),
                F.when(k == F.size(heads) - 1, cut(blocks, reach(k), F.lit(1 << 30))).otherwise(F.lit(""))))
            return F.array_join(each, "")

        return bound(fresh, parts)

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    text = F.when(F.size("pii") > 0, bound(pieces, lambda blocks: bound(ordered, lambda o: bound(F.transform(o, lambda x: x["end"]), lambda each: bound(
        highest(each), lambda ends: masked(o, ends, blocks)))))).otherwise(F.col("text"))
    return found.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, spans per fixed format, digest of the fixed spans, all spans.

    A null text counts as empty and has none; rows with the same id or text are told of each on their own.
    """
    found = detect(docs.select("doc_id", "text"), s)
    return found.select("doc_id", *[F.col("n_fixed")[k].alias(f"n_{k}") for k in FORMATS],
                        F.sha2(listed("base"), 256).alias("base_sha256"), listed("pii").alias("spans"))
