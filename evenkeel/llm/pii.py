"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from patterns. Regex, gazetteer and context labelers vote for or against each or abstain. Votes are
counted by pattern; expectation-maximisation over the (bounded) table of vote patterns estimates how often each
labeler votes which way for true and for false candidates; the resulting probabilities train a final classifier
over a candidate's features (log-odds of soft counts). Candidates of the four base kinds that pass their check are
always spans; of the others, those that the classifier accepts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm.common import unused

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
# Patterns: leftmost matches start where a run starts, so a look-behind keeps long runs linear; groups that repeat
# without bound are possessive, which the matcher runs as a loop. Card runs of another length never match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9A-Za-z+)-])(?<![+0-9][ -])(?:\([0-9]{3}\)|[0-9]{3})[ -][0-9]{3}-[0-9]{4}(?![0-9A-Za-z-])",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-", "local_phone": "-"}  # a plain search spares most texts the pattern
# fixed values: gazetteers
ZONES_ = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "us", "eu", "it", "nl", "ch", "at")
COUNTRIES = ("1", "33", "34", "39", "41", "43", "44", "49", "31", "32", "351", "52", "54", "55", "61", "81", "86", "91")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35)"
IBAN_COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
CUES = {
    "email": r"(?i)(e-?mail|mail|contact|write|kontakt|correo|courriel|from|reach)",
    "ip": r"(?i)(\bip\b|address|host|server|client|login|addr)",
    "card": r"(?i)(card|credit|visa|master|amex|karte|carte|tarjeta|payment)",
    "phone": r"(?i)(phone|tel|call|mobile|fax|anruf|appel|llam)",
    "iban": r"(?i)(iban|account|bank|konto|compte|cuenta)",
    "ssn": r"(?i)(ssn|social|security|insurance|identification)",
    "local_phone": r"(?i)(phone|tel|call|mobile|fax)",
}
CONTEXT = 40  # characters before a candidate in which cues are sought
LABELERS = ("regex", "gazetteer", "cue", "edges", "shape")
ROUNDS = 12
ACCEPT = 0.5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` names it within a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the check; every second digit from the right is doubled."""

    def add(all_: Column, total: Column, i: Column) -> Column:
        d = F.substr(all_, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return let(
        F.reverse(digits(value)),
        lambda all_: F.aggregate(F.sequence(F.lit(1), F.length(all_)), F.lit(0), lambda t, i: add(all_, t, i)) % 10 == 0,
    )


def mod97(value: Column) -> Column:
    """ISO 13616 check of an IBAN without its spaces: letters as 10 to 35, the first four characters moved last."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))

    def add(all_: Column, rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(all_, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return let(
        moved, lambda all_: F.aggregate(F.sequence(F.lit(1), F.length(all_)), F.lit(0), lambda r, i: add(all_, r, i)) == 1
    )


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    if kind == "ssn":  # never issued
        return ~F.rlike(value, F.lit("^(000|666)|-00-|-0000$"))
    return mod97(value) if kind == "iban" else F.lit(True)


def candidates(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value, before, after>> of a kind's matches in order, code points.

    The text is split at the matches; the lengths of the parts and matches add up to the places.
    """
    pattern = F.lit(PATTERNS[kind])
    shape = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"
    nothing = F.array().cast(shape)

    def step(found: Column, parts: Column, state: Column, i: Column) -> Column:
        value, part = F.get(found, i), F.get(parts, i)
        start = state["at"] + F.length(part)
        end = start + F.length(value)
        one = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"),
            F.right(part, F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(1)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one).cast(shape)).alias("out"))

    def placed(both: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
        index = F.sequence(F.lit(0), F.size(both["found"]) - 1)
        return F.aggregate(index, start, lambda state, i: step(both["found"], both["parts"], state, i))["out"]

    both = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, PATTERNS[kind], -1).alias("parts")
    )
    needed = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    return F.when(needed & F.rlike(text, pattern), let(both, placed)).otherwise(nothing)


def by_kind(choose: Callable[[str], Column], kind: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``choose(kind)`` of the candidate's kind; kinds without a rule of their own get 0."""
    return reduce(lambda rest, k: F.when(kind == k, choose(k)).otherwise(rest), kinds[::-1], F.lit(0))


def vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def gazetteer(kind: str, value: Column) -> Column:
    d = digits(value)
    if kind == "email":
        return vote(F.lower(F.substring_index(value, ".", -1)).isin(*ZONES_), F.lit(False))
    if kind in ("phone", "local_phone"):
        known = reduce(lambda a, b: a | b, [F.startswith(d, F.lit(c)) for c in COUNTRIES])
        return vote(known & F.lit(kind == "phone"), F.startswith(d, F.lit("0")) & F.lit(kind == "phone"))
    if kind == "card":
        return vote(F.rlike(d, F.lit(ISSUERS)), F.startswith(d, F.lit("0")))
    if kind == "iban":
        return vote(F.substring(value, 1, 2).isin(*IBAN_COUNTRIES), F.lit(False))
    if kind == "ssn":
        return vote(F.lit(False), F.rlike(value, F.lit("^(000|666|9)|-00-|-0000$")))
    return vote(F.lit(False), F.rlike(value, F.lit(r"^(0|127|255)\.")))


def votes(c: Column) -> dict[str, Column]:
    """One vote (1, -1 or 0) of each labeler on a candidate."""
    value, kind, before, after = c["value"], c["kind"], c["before"], c["after"]
    last = F.right(before, F.lit(1))
    cues = F.element_at(F.create_map(*[F.lit(x) for k, cue in CUES.items() for x in (k, cue)]), kind)
    return {
        "regex": by_kind(lambda k: vote(valid(k, value), ~valid(k, value)), kind, ("ip", "card", "phone", "iban")),
        "gazetteer": by_kind(lambda k: gazetteer(k, value), kind),
        "cue": vote(F.rlike(before, cues), F.lit(False)),
        "edges": vote(
            F.rlike(last, F.lit(r"^[\s,;:(<\[\"']?$")) & F.rlike(after, F.lit(r"^[\s.,;:)>\]\"']?$")),
            F.rlike(last, F.lit(r"\w")) | F.rlike(after, F.lit(r"\w")),
        ),
        "shape": vote(
            F.lit(False),
            (kind != "email") & F.rlike(digits(value), F.lit(r"^(\d)\1+$"))
            | F.rlike(before, F.lit(r"(?i)(version|release|\bv|§|chapter)\s*$")),
        ),
    }


def side(c: Column) -> Column:
    return F.when(c == "", "none").when(F.rlike(c, F.lit(r"\s")), "space").when(F.rlike(c, F.lit(r"\w")), "word").otherwise("sign")


def features(c: Column, cast: dict[str, Column]) -> Column:
    """Names of a candidate's features, of which there are a few dozen in all."""
    named = [F.concat(F.lit(f"{name}="), c["kind"], F.lit(":"), v.cast("string")) for name, v in cast.items()]
    size = F.least(F.lit(40), F.floor(F.length(c["value"]) / 4) * 4).cast("string")
    return F.array(
        *named,
        F.concat(F.lit("size="), c["kind"], F.lit(":"), size),
        F.concat(F.lit("before="), side(F.right(c["before"], F.lit(1)))),
        F.concat(F.lit("after="), side(c["after"])),
    )


def numbered(text: Column, found: Column) -> Column:
    """``found``, which needs a digit in the text, or nothing."""
    return F.when(F.rlike(text, F.lit("[0-9]")), found).otherwise(F.array())


def all_candidates(text: Column) -> Column:
    return F.concat(candidates(text, "email"), numbered(text, F.concat(*[candidates(text, k) for k in KINDS[1:]])))


def expectation_maximisation(patterns: DataFrame) -> tuple[float, dict[str, dict[int, tuple[float, float]]]]:
    """Share of true candidates, and per labeler and vote its probability for true and for false candidates.

    ``patterns``: one row per combination of votes with its count ``n``, at most 3^5 rows. One aggregation a round.
    """
    begin = {1: (0.6, 0.1), 0: (0.3, 0.3), -1: (0.1, 0.6)}
    prior, table = 0.7, {name: dict(begin) for name in LABELERS}
    ballots = F.explode(F.array(*[F.struct(F.lit(name).alias("labeler"), F.col(name).alias("vote")) for name in LABELERS]))
    for _ in range(ROUNDS):
        p = posterior(prior, table, {name: F.col(name) for name in LABELERS})
        soft = patterns.select("n", p.alias("p"), ballots.alias("b"))
        sums = soft.groupBy("b.labeler", "b.vote").agg(
            F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")
        )
        seen = {(r["labeler"], r["vote"]): (r["yes"], r["no"]) for r in sums.collect()}  # three votes by labeler
        yes, no = (sum(x[side] for (name, _), x in seen.items() if name == LABELERS[0]) for side in (0, 1))
        before, prior = prior, min(0.99, max(0.01, (yes + 1) / (yes + no + 2)))
        # start values weigh in as ten candidates, so that true stays true and unseen votes stay possible
        table = {
            name: {
                v: ((seen.get((name, v), (0.0, 0.0))[0] + 10 * a) / (yes + 10), (seen.get((name, v), (0.0, 0.0))[1] + 10 * b) / (no + 10))
                for v, (a, b) in begin.items()
            }
            for name in LABELERS
        }
        if abs(prior - before) < 1e-4:
            break
    return prior, table


def posterior(prior: float, table: dict, cast: dict[str, Column]) -> Column:
    z = F.lit(math.log(prior / (1 - prior)))
    for name, by_vote in table.items():
        odds = {v: math.log(a / b) for v, (a, b) in by_vote.items()}
        z = z + F.when(cast[name] == 1, odds[1]).when(cast[name] == -1, odds[-1]).otherwise(odds[0])
    return 1 / (1 + F.exp(-z))


def train(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Feature weights of the span classifier (and the intercept under ``""``), from all candidates of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # an outer explode with a filter after it: an inner one would make the optimiser test, so compute, the array twice
    each = docs.select(F.explode_outer(all_candidates(text)).alias("c")).filter("c is not null")
    voted = each.select("c", *[v.alias(name) for name, v in votes(F.col("c")).items()])
    voted = voted.select(*LABELERS, features(F.col("c"), {name: F.col(name) for name in LABELERS}).alias("features"))
    counted = voted.groupBy(*LABELERS, "features").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.collect()  # combinations of a few dozen feature names, not candidates
    if not rows:
        return {"": 0.0}
    counted = docs.sparkSession.createDataFrame(rows, counted.schema)
    patterns = counted.groupBy(*LABELERS).agg(F.sum("n").alias("n"))
    prior, table = expectation_maximisation(docs.sparkSession.createDataFrame(patterns.collect(), patterns.schema))
    soft = counted.withColumn("p", posterior(prior, table, {name: F.col(name) for name in LABELERS}))
    total = soft.agg(F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p")))).first()
    yes, no = (total[0] or 0.0) + 1, (total[1] or 0.0) + 1
    by_feature = soft.select(F.explode("features").alias("feature"), "n", "p").groupBy("feature").agg(
        F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")
    )
    weights = {r["feature"]: math.log((r["yes"] + 0.5) / yes) - math.log((r["no"] + 0.5) / no) for r in by_feature.collect()}
    return weights | {"": math.log(yes / no)}


def spans(text: Column, weights: dict[str, float]) -> Column:
    """array<struct<kind, start, end>> by kind as listed, then start: valid base spans and accepted others."""
    known = F.create_map(*[x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(float(w)))])

    def accepted(c: Column) -> Column:
        cast = F.struct(*[v.alias(name) for name, v in votes(c).items()])
        names = let(cast, lambda v: features(c, {name: v[name] for name in LABELERS}))
        z = F.aggregate(names, F.lit(weights[""]), lambda a, f: a + F.coalesce(F.element_at(known, f), F.lit(0.0)))
        return 1 / (1 + F.exp(-z)) >= ACCEPT

    def checked(kind: str) -> Column:
        return F.filter(candidates(text, kind), lambda c: valid(kind, c["value"]))

    def free(held: Column, more: Column) -> Column:
        others = F.filter(
            more, lambda c: accepted(c) & ~F.exists(held, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        )
        return F.transform(
            F.concat(held, others), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
        )

    held = F.concat(checked("email"), numbered(text, F.concat(*[checked(k) for k in BASE[1:]])))
    more = numbered(text, F.concat(*[checked(k) for k in KINDS[len(BASE) :]]))
    return let(F.struct(held.alias("held"), more.alias("more")), lambda s: free(s["held"], s["more"]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, found`` (array of kind, start, end).

    Two passes over the texts: one trains, one applies; nothing but counts of votes and features is shuffled or
    collected. Null text is empty; texts are read whole; repeated rows give equal rows; empty tables give an empty
    result; other columns are ignored.
    """
    weights = train(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", spans(F.col("text"), weights).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    def text(spans_: Column) -> Column:
        return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans")
    )


def masked(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (of overlapping spans the first, then the longer);
    ``size_col``, if the table has it, is the new length. Null text stays null; all other columns are as they were."""
    weights = train(docs, text_col)
    own = unused(docs, "own_spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ordered = F.array_sort(F.transform(F.col(own), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        end = -s["back"]
        piece = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        out = F.concat(state["out"], piece, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fits = s["start"] >= state["at"]
        return F.struct(F.when(fits, end).otherwise(F.greatest(state["at"], end)).alias("at"), F.when(fits, out).otherwise(state["out"]).alias("out"))

    state = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    new = F.concat(state["out"], F.substr(text, state["at"] + 1, F.length(text)))
    out = docs.withColumn(own, F.coalesce(spans(text, weights), F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    out = out.withColumn(text_col, F.when(F.size(own) > 0, new).otherwise(F.col(text_col)))
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.when(F.size(own) > 0, F.length(text_col)).otherwise(F.col(size_col)).cast(docs.schema[size_col].dataType))
    return out.select(docs.columns)
