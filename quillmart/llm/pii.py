"""Personal data in whole texts: rules, and boosted trees over spans that broad generators propose.

Built of SQL functions alone. Four rules find the base spans: e-mail addresses, IP addresses, card
numbers and phone numbers. Broad generators propose further, overlapping spans. Boosted trees score a
proposal by its format and its context. They learn from all base spans, their deciding mark masked, as examples
of what the rules miss, against all other proposals in all texts, which are unlabelled. A proposal
is redacted when it meets no base span, its score reaches the threshold of its kind, and no better proposal
overlaps it. Thresholds are calibrated on rows kept out of training: the lowest score from which on the share
of personal data, as far as proposals score like masked spans, is ``precision``. So the more there is to find,
the more is found.

Offsets are code points, the end exclusive. Defined results: a NULL text is an empty text, and has no
spans; an empty table has no rows. Texts of any length are searched whole. Of overlapping proposals that reach their threshold the longer
is better, then the one of the higher score, the earlier, and by the kind's name. Repeated rows give equal rows. If there is no base span, or
no other proposal, the trees add nothing. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import quoted, stored

KINDS = ("email", "ip", "card", "phone")

# The given patterns. Possessive loops find the same matches without backtracking; a match of e-mail or IP
# that fails from the start of a run of its characters fails from within the run as well, so that runs
# are tried from their start, or from the end of the match before.
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Generators: obfuscated addresses, numbers with any separators, national phone numbers, four groups.
AT = r"(?:@|(?i:[(\[{]at[)\]}]|\x20at\x20))"
DOT = r"(?:\.|(?i:[(\[{]dot[)\]}]|\x20dot\x20))"
GENERATORS = (
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?{AT}\x20?[A-Za-z0-9-]++(?:\x20?{DOT}\x20?[A-Za-z0-9-]++)++",
    r"(?<![0-9])[+(]?[0-9][0-9\x20().-]{5,24}[0-9](?![0-9])",
    r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    r"(?<![0-9])[0-9]{1,4}(?:(?:[\x20.,:-]|\[\.\])[0-9]{1,4}){3}(?![0-9])",
)
CONTEXT = 24
AROUND = 64  # characters of a known span's text, on either side, in which its masked form is looked for
CONTEXT_WORDS = (
    r"(?i)phone|tel|call|fax|mobil",
    r"(?i)card|visa|account|konto|carte|tarjeta",
    r"(?i)\bip\b|host|server|addr",
    r"(?i)mail|contact|kontakt",
)
#: Features are whole numbers up to this.
LARGEST = 63


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs ``start``, ``end``, ``value``, in their order.

    What lies between the matches gives their places.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)  # one more than matches
    pairs = F.zip_with(gaps, values, lambda g, v: F.struct(F.char_length(g).alias("gap"), v.alias("value")))
    none = F.expr("CAST(array() AS array<struct<start: int, end: int, value: string>>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        spans = F.when(x["value"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span)))
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"]
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def small_part(part: Column) -> Column:
    """Whether a run of digits is a number up to 255."""
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) <= 3) & (F.concat(F.lit("0"), F.substring(plain, 1, 3)).cast("int") <= 255)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the four rules, by kind. Cheap tests keep most texts away from the patterns."""
    none = F.expr("CAST(array() AS array<struct<start: int, end: int, value: string>>)")

    def where(condition: Column, pattern: str, holds) -> Column:
        return F.when(condition, F.filter(matches(text, pattern), lambda s: holds(s["value"]))).otherwise(none)

    n_digits = lambda v: F.length(digits(v))
    return {
        "email": where(text.contains("@"), EMAIL, lambda v: F.lit(True)),
        "ip": where(
            text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
            IP,
            lambda v: F.forall(F.split(v, r"\."), small_part),
        ),
        "card": where(
            text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
            CARD,
            lambda v: n_digits(v).between(16, 19) & F.call_function("luhn_check", digits(v)),
        ),
        "phone": where(text.contains("+"), PHONE, lambda v: n_digits(v).between(8, 15)),
    }


def with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and one array ``base`` of structs ``kind``, ``start``, ``end``, by kind and start."""
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))

    def named(kind: str, spans: Column) -> Column:
        return F.transform(
            spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        )

    arrays = [named(*item) for item in base_spans(F.col("text")).items()]
    return rows.select("id", "text", F.concat(*arrays).alias("base"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def proposals(rows: DataFrame) -> DataFrame:
    """``rows`` with an array ``proposed``: place, kind, features, and whether a base span is met.

    The guard of a generator is a part of its pattern, so that no match is lost by it.
    """
    text = F.col("text")
    none = F.expr("CAST(array() AS array<struct<start: int, end: int, value: string, g: int>>)")
    guards = (
        text.rlike(rf"{AT}\x20?[A-Za-z0-9-]++\x20?{DOT}"),
        text.rlike(r"[0-9][0-9\x20().-]{5}"),
        text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
        text.rlike(r"[0-9](?:(?:[\x20.,:-]|\[\.\])[0-9]{1,4}){3}"),
    )

    def generated(g: int, guard: Column, pattern: str) -> Column:
        fields = lambda s: (s[c].alias(c) for c in ("start", "end", "value"))
        spans = F.transform(matches(text, pattern), lambda s: F.struct(*fields(s), F.lit(g).alias("g")))
        return F.when(guard, spans).otherwise(none)

    found = [generated(g, *x) for g, x in enumerate(zip(guards, GENERATORS, strict=True))]

    def count_of(value: Column, pattern: str) -> Column:
        return F.length(value) - F.length(F.regexp_replace(value, pattern, ""))

    def side(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), 2).when(c.rlike(r"[\p{L}_=\"]"), 1).otherwise(0)

    def describe(s: Column) -> Column:
        v = s["value"]
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.substring(text, first + 1, s["start"] - first)
        groups = F.filter(F.split(v, "[^0-9]+"), lambda p: p != "")
        mail = F.when(s["g"] == 0, 1).otherwise(0)
        features = (
            F.length(digits(v)),
            F.length(v),
            F.size(groups),
            count_of(v, r"\."),
            count_of(v, "-"),
            count_of(v, r"\x20"),
            count_of(v, "[()]"),
            F.when(F.call_function("luhn_check", digits(v)), 1).otherwise(0),
            F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
            F.when(F.forall(groups, small_part), 1).otherwise(0),
            side(F.substring(before, -1, 1)),
            side(F.substring(text, s["end"] + 1, F.lit(1))),
            s["g"],
            *(F.when(before.rlike(words), 1).otherwise(0) for words in CONTEXT_WORDS),
        )
        kind = (
            F.when(mail == 1, "email")
            .when((F.size(groups) == 4) & F.forall(groups, small_part) & ~v.rlike("[+(]"), "ip")
            .when(F.length(digits(v)) >= 13, "card")
            .otherwise("phone")
        )
        return F.struct(
            kind.alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.exists("base", lambda b: overlaps(s, b)).alias("is_base"),
            F.array(*(F.least(f, F.lit(LARGEST)).cast("int") for f in features)).alias("f"),
        )

    return rows.withColumn("proposed", F.transform(F.concat(*found), describe))


@dataclass(frozen=True)
class Settings:
    """What training depends on."""

    trees: int = 8
    rate: float = 0.5
    smoothing: float = 1.0
    precision: float = 0.9
    share: float = 0.1  # least of the masked spans of a form that a threshold accepts
    most_missed: float = 4.0  # spans missed for each one known; more of one look are taken for something else


@dataclass(frozen=True)
class Split:
    """Go left if the feature is at most ``at``."""

    feature: int
    at: int

    def left(self, f: Column) -> Column:
        return f[self.feature] <= self.at


@dataclass(frozen=True)
class Tree:
    """A split, a split on each side, and the four values."""

    top: Split
    sides: tuple[Split, Split]
    values: tuple[float, float, float, float]

    def leaf(self, f: Column, values: tuple) -> Column:
        a, b = self.sides
        return F.when(
            self.top.left(f), F.when(a.left(f), values[0]).otherwise(values[1])
        ).otherwise(F.when(b.left(f), values[2]).otherwise(values[3]))


@dataclass(frozen=True)
class Model:
    """Boosted trees and the threshold of each kind that has one."""

    bias: float = 0.0
    trees: tuple[Tree, ...] = ()
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin(self, f: Column) -> Column:
        margin = F.lit(self.bias)
        for tree in self.trees:
            margin = margin + tree.leaf(f, tuple(map(F.lit, tree.values)))
        return margin

    def score(self, f: Column) -> Column:
        return F.lit(1.0) / (1 + F.exp(-self.margin(f)))


def masked(rows: DataFrame) -> DataFrame:
    """Known spans without the mark by which the rules know them, within some of their text.

    ``rows`` are those of ``with_base``. Of an address the sign goes, and in half of the cases the dots; of a phone
    number the plus, in half of the cases with a country code that stands alone; a card's digits are grouped by
    dots; an IP address gets brackets. Columns ``id``, ``text``, an empty ``base``, and
    ``low`` and ``high`` of the masked span and its ``form``, the way it is masked.
    """
    spans = rows.select("id", "text", F.explode("base").alias("s")).select(
        "id", "text", "s.kind", "s.start", "s.end", F.xxhash64("id", "text", "s.start", "s.kind").alias("at")
    )
    part = lambda start, n: F.substring(F.col("text"), start + 1, n)
    value = part(F.col("start"), F.col("end") - F.col("start"))
    place = F.pmod("at", F.lit(4))
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    sign = F.when(place % 2 == 0, " at ").otherwise("(at)")
    dots = F.when(place == 2, F.replace(domain, F.lit("."), F.lit(" dot "))).when(
        place == 3, F.replace(domain, F.lit("."), F.lit("(dot)"))
    ).otherwise(domain)
    grouped = F.regexp_replace(digits(value), "([0-9]{4})(?=[0-9])", r"$1.")
    hidden = (
        F.when(F.col("kind") == "email", F.concat(name, sign, dots))
        .when(F.col("kind") == "phone", F.regexp_replace(value, F.when(place % 2 == 0, r"^\+").otherwise(r"^\+[0-9]{1,3}(?![0-9])[\x20.-]?"), F.lit("")))
        .when(F.col("kind") == "card", grouped)
        .otherwise(F.replace(value, F.lit("."), F.lit("[.]")))
    )
    first = F.greatest(F.col("start") - AROUND, F.lit(0))
    before = part(first, F.col("start") - first)
    after = part(F.col("end"), F.lit(AROUND))
    low = F.char_length(before)
    none = F.expr("CAST(array() AS array<struct<kind: string, start: int, end: int>>)")
    # A span of repeated rows counts once. Only the text around it is moved.
    return spans.select(
        F.col("at").alias("id"), F.concat(before, hidden, after).alias("text"), none.alias("base"),
        low.alias("low"), (low + F.char_length(hidden)).alias("high"), place.cast("int").alias("form"),
    ).dropDuplicates(["id"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> Model:
    """Trees and thresholds from known spans whose deciding mark is masked, and from the proposals in all texts.

    A proposal that covers a masked span is an example of personal data that the rules miss (``y`` is 1). The other
    proposals, but for those that meet a base span, are unlabelled: some of them may be personal data, so they
    are never counted as errors. The trees learn what sets the masked spans apart from them. All of them are learned
    from: those of one kind, form and features are one row with their number.
    """
    s = settings or Settings()
    rows = with_base(docs, id_col, text_col)
    found = proposals(rows).select("id", F.inline("proposed")).filter(~F.col("is_base"))
    unknown = found.select(
        "kind", "f", F.lit(0).alias("y"), F.lit(-1).alias("form"), F.xxhash64("id", "start", "end", "f").alias("at")
    )
    covers = lambda c: (c["start"] <= F.col("low") + 1) & (c["end"] >= F.col("high") - 1)
    known = proposals(masked(rows)).select("id", "form", F.inline(F.filter("proposed", covers)))
    known = known.select("kind", "f", F.lit(1).alias("y"), "form", F.xxhash64("id", "start", "end").alias("at"))
    kept = (F.pmod("at", F.lit(3)) == 0).alias("kept")
    alike = unknown.unionByName(known).groupBy("kind", "f", "y", "form", kept).agg(F.count("*").alias("n"))
    counted = stored(alike, "proposals")
    train = counted.filter(~F.col("kept"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n, positive = train.agg(total(F.col("n")), total(F.col("n") * F.col("y"))).first()
    if not 0 < positive < n:
        return Model()
    model = Model(math.log(positive / (n - positive)))
    for _ in range(s.trees):
        tree = grow(train, model, s)
        if tree is None:
            break
        model = Model(model.bias, (*model.trees, tree))
    return Model(model.bias, model.trees, thresholds(counted.filter("kept"), model, s))


def grow(train: DataFrame, model: Model, s: Settings) -> Tree | None:
    """The next tree, from sums of the loss's slopes and curvatures per feature value over ``n`` of each row."""
    p, n = model.score(F.col("f")), F.col("n")
    rows = train.select("f", (n * (F.col("y") - p)).alias("g"), (n * p * (1 - p)).alias("h"))

    def sums(node: Column) -> dict[int, dict[int, dict[int, tuple[float, float]]]]:
        """By node, feature and value; at most nodes x features x values rows."""
        out: dict = {}
        found = (
            rows.select(node.alias("node"), "g", "h", F.posexplode("f").alias("feature", "v"))
            .groupBy("node", "feature", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        )
        for r in found:
            out.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["v"]] = (r["g"], r["h"])
        return out

    def best(features: dict[int, dict[int, tuple[float, float]]]) -> tuple[Split, float, float] | None:
        """The split that lowers the loss most, and the values on its sides."""
        found = None
        for j, values in sorted(features.items()):
            g_all, h_all = (sum(x[i] for x in values.values()) for i in (0, 1))
            g = h = 0.0
            for v in sorted(values)[:-1]:
                g, h = g + values[v][0], h + values[v][1]
                rest_g, rest_h = g_all - g, h_all - h
                gain = g * g / (h + s.smoothing) + rest_g**2 / (rest_h + s.smoothing)
                if found is None or gain > found[0] + 1e-9:
                    sides = (s.rate * g / (h + s.smoothing), s.rate * rest_g / (rest_h + s.smoothing))
                    found = (gain, Split(j, v), *sides)
        return found and found[1:]

    first = best(sums(F.lit(0)).get(0, {}))
    if first is None:
        return None
    top = first[0]
    below = sums(F.when(top.left(F.col("f")), 0).otherwise(1))
    # A side without a further split keeps one value.
    sides = [best(below.get(i, {})) or (Split(0, LARGEST), first[1 + i], 0.0) for i in (0, 1)]
    return Tree(top, (sides[0][0], sides[1][0]), (*sides[0][1:], *sides[1][1:]))


def thresholds(kept: DataFrame, model: Model, s: Settings) -> dict[str, float]:
    """Per kind the lowest score at and above which personal data have the share ``precision``.

    Scores are compared in steps of one on the scale of log odds. Of the unlabelled proposals, those that are
    personal data of a form score like the spans masked in this form. So the proposals at and above any score, over
    the share of the masked spans there, each with a standard deviation in favour, bound their number from above;
    the least of these bounds is taken for it, over scores that at least ``share`` of the masked spans reach. That
    number times the share of masked spans, over all proposals at and above a score, is the precision there, and
    the form of the highest counts. A score that far more unlabelled proposals reach than known spans tells
    nothing. Where no score lies, the threshold is in the middle.
    """
    step = F.floor(model.margin(F.col("f"))).cast("int")
    # At most kinds x forms x the range of the margin, which the trees' number and rate bound.
    counts = kept.groupBy("kind", "form", step.alias("step")).agg(F.sum("n").alias("n")).collect()
    out: dict[str, float] = {}
    for kind in sorted({r["kind"] for r in counts}):
        own = {(r["form"], r["step"]): r["n"] for r in counts if r["kind"] == kind}
        steps = sorted({at for _, at in own}, reverse=True)
        reach = lambda form: list(itertools.accumulate(own.get((form, at), 0) for at in steps))  # noqa: E731, B023
        unknown, forms = reach(-1), [reach(form) for form in sorted({f for f, _ in own if f >= 0})]
        precision = [0.0] * len(steps)
        for form in forms:
            shares = [n / form[-1] for n in form]
            least = [max(x - math.sqrt(x * (1 - x) / form[-1]), x / 2) for x in shares]
            most = [u + 1 + math.sqrt(u + 1) for u in unknown]
            number = min(u / x for u, x, share in zip(most, least, shares, strict=True) if share >= s.share)
            precision = [max(p, number * x / max(u, 1)) for p, u, x in zip(precision, unknown, shares, strict=True)]
        masked_there = [sum(x) for x in zip(*forms, strict=True)] or [0] * len(steps)
        for i, at in enumerate(steps):
            known = 0 < masked_there[i] and unknown[i] <= s.most_missed * masked_there[i] + 1
            if known and precision[i] >= s.precision:
                below = steps[i + 1] + 1 if i + 1 < len(steps) else at
                out[kind] = 1 / (1 + math.exp(-(at + below) / 2))
    return out


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, text, ``base`` spans and ``added`` spans, each an array of ``kind``, ``start``, ``end``."""
    rows = with_base(docs, id_col, text_col)
    if not model.thresholds:
        return rows.withColumn("added", F.slice("base", 1, 0))
    limit = F.create_map(*(F.lit(x) for item in sorted(model.thresholds.items()) for x in item))
    scored = F.transform(
        F.filter("proposed", lambda c: ~c["is_base"]),
        lambda c: F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), model.score(c["f"]).alias("score")
        ),
    )
    chosen = F.filter(scored, lambda c: c["score"] >= F.coalesce(F.try_element_at(limit, c["kind"]), F.lit(2.0)))

    def better(o: Column, c: Column) -> Column:
        """The longer first, then the higher score, the earlier, the kind's name."""
        rank = lambda x: F.struct(x["start"] - x["end"], -x["score"], x["start"], x["kind"])
        return overlaps(o, c) & (rank(o) < rank(c))

    plain = proposals(rows).withColumn("chosen", chosen)
    best = F.filter("chosen", lambda c: ~F.exists("chosen", lambda o: better(o, c)))
    added = F.array_distinct(
        F.transform(best, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    )
    return plain.select("id", "text", "base", added.alias("added"))


def redact(found: DataFrame, mask: str = "[{}]") -> DataFrame:
    """``found`` with ``redacted``: the text with every span, base or added, replaced by its kind.

    Overlapping spans are replaced together, by the kind of the one that starts first.
    """
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    text = F.col("text")

    def add(acc: Column, s: Column) -> Column:
        pre, post = mask.split("{}")
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        name = F.concat(F.lit(pre), s["kind"], F.lit(post))
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, name))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    tail = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return found.withColumn("redacted", F.aggregate(spans, start, add, tail))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, the digest of the base spans and the list of all spans."""

    def listed(spans: Column) -> Column:
        order = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
        by = F.array_sort(F.transform(spans, lambda s: F.struct(order(s), s["start"], s["end"], s["kind"].alias("kind"))))
        return F.array_join(
            F.transform(by, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias(id_col),
        *map(count_of, KINDS),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
    )
