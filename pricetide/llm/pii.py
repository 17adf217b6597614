"""Personal data: fixed patterns, and further spans that weak labelers agree on.

Four kinds have an exact definition (``BASE``) and are always reported.  Looser
patterns propose candidates of further kinds.  Labelers - shape, gazetteer, context and
checksum - vote on every candidate and on every match of a base pattern:
1 for personal, -1 for not, 0 for no opinion.  Nobody has marked the truth, so
expectation-maximisation estimates it together with each labeler's
reliability, from how often which votes occur together.  The estimate trains
a span classifier (naive Bayes over the span's form and surroundings); candidates it is sure
of are added.

All work on texts is column expressions.  What reaches the driver is one count
per combination of votes and features; their number is bounded by the
definitions below (``MAX_COMBINATIONS``) and not by the data.
"""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.regex import let

# The four kinds and their patterns.  Possessive quantifiers and
# look-behinds match the same spans as the plain forms [A-Za-z0-9._%+-]+@...,
# [0-9]+(\.[0-9]+)..., [0-9]([ -]?[0-9])+ without retrying inside a run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs to hold a match that counts; spares most texts the splitting.
NEEDS = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns, proposed only.  Repeated groups are possessive: the regular
#: expressions of the JVM match those in a loop, others by a call within a call per repeat.
PROPOSED = {
    "email_like": r"(?i)(?<![\w.%+-])[\w.%+-]{2,64}+ ?(?:\(at\)|\[at\]| at )\s?[a-z0-9-]{2,63}+(?: ?(?:\(dot\)|\[dot\]| dot )\s?[a-z0-9-]{2,63}+)++",
    "number_like": r"(?<![\w+.-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![\w.-])",
    "person_like": r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}[\p{L}'-]++(?: \p{Lu}[\p{L}'-]++)?",
    "secret_like": r"(?i)(?<![a-z])(?:pass(?:word|wd|code)?|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;]{6,}+[\"']?",
}
KINDS = [*BASE, *PROPOSED]
DOMAINS = r"(?i)[. ](?:com|org|net|edu|gov|info|biz|io|de|fr|es|uk|eu)(?![a-z0-9])"
TITLES = r"^(?:Mr|Mrs|Ms|Dr|Prof)\.? "
ASKED_FOR = r"(?i)(?:call|phone|tel|mobile|fax|mail|contact|write to|card|visa|ssn|social security|passport|login|ip address|address|password|account)[^\p{L}]{0,4}(?:\p{L}{1,6}[^\p{L}]{1,3})?$"
MEASURED = r"(?i)(?:version|isbn|issn|page|pages|figure|total|price|order|serial|part no|[$€£#%])[^\p{L}0-9]{0,3}$"
LABELERS = ["shape", "gazetteer", "context", "form", "checksum"]
FEATURES = ["kind", "digits", "joined", "left", "right"]
MAX_COMBINATIONS = len(KINDS) * 3 ** len(LABELERS) * 5 * 2 * 4 * 4
ROUNDS = 30
#: Probability from which a proposed span is added.
SURE = 0.9

#: Matches of a text that are placed together.
CHUNK = 256
SPAN = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches with their place in code points and some text on either side."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, 2, 1 << 30).alias("next"))

    def add(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["0"])
        end = start + F.coalesce(F.length(row["1"]), F.lit(0))
        found = F.struct(
            start.alias("start"), end.alias("end"), row["1"].alias("hit"),
            F.right(row["0"], F.lit(40)).alias("before"), F.left(row["2"], F.lit(8)).alias("after"),
        )
        return F.struct(end.alias("at"), F.when(row["1"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(found))).alias("out"))

    empty = F.array().cast(SPAN)
    rows = F.transform(rows, lambda r: F.struct(r["gap"].alias("0"), r["hit"].alias("1"), r["next"].alias("2")))

    def walked(rows: Column) -> Column:
        """Chunk by chunk, since adding to an array copies it: what is copied is a chunk, however many matches a text has."""

        def chunk(c: Column) -> Column:
            return F.slice(rows, c * CHUNK + 1, F.lit(CHUNK))

        def size(total: Column, row: Column) -> Column:
            return total + F.length(row["0"]) + F.coalesce(F.length(row["1"]), F.lit(0))

        def from_places(at: Column) -> Column:
            start = lambda c: F.struct(F.get(at, c).alias("at"), empty.alias("out"))
            return F.flatten(F.transform(chunks, lambda c: F.aggregate(chunk(c), start(c), add, lambda s: s["out"])))

        chunks = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int"))
        sizes = F.transform(chunks, lambda c: F.aggregate(chunk(c), F.lit(0), size))
        places = F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return let(places, from_places)

    return F.when(text.rlike(needs), let(rows, walked)).otherwise(empty)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step) % 10 == 0


def _counts(kind: str, hit: Column) -> Column:
    """Whether a match of a base pattern counts."""
    number = F.length(digits(hit))
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return number.between(13, 19) & F.when(number.between(13, 19), passes_luhn(digits(hit))).otherwise(False)
    return number.between(9, 15) if kind == "phone" else F.lit(True)


def _is_base(kind: str, s: Column) -> Column:
    return _counts(kind, s["hit"])


def _all_matches(text: Column) -> Column:
    """One struct with an array of matches per kind; base matches that do not count are still in."""
    each = [_matches(text, BASE[k], NEEDS[k]).alias(k) for k in BASE] + [_matches(text, p, p).alias(k) for k, p in PROPOSED.items()]
    return F.struct(*each)


def _described(kind: str, s: Column) -> Column:
    """Votes and features of a match."""
    hit, before, number = s["hit"], s["before"], digits(s["hit"])
    count = F.length(number)
    bare = hit.rlike(r"^[0-9]+$")
    shape = {
        "email": F.lit(1), "email_like": F.lit(1), "person_like": F.lit(0),
        "ip": F.when(_counts("ip", hit), 1).otherwise(-1), "card": F.when(count.between(13, 19), 1).otherwise(-1),
        "phone": F.when(count.between(9, 15), 1).otherwise(-1),
        "number_like": F.when(hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), 1).otherwise(0),
        "secret_like": F.when(hit.rlike(r"[=:]\s*[\"']?(?=[^\s]*[0-9])(?=[^\s]*[A-Za-z])[^\s]{8,}"), 1).otherwise(-1),
    }[kind]
    gazetteer = F.when(hit.rlike(DOMAINS) | hit.rlike(TITLES), 1).otherwise(F.when(F.lit(kind.startswith("email")), -1).otherwise(0))
    context = F.when(before.rlike(ASKED_FOR), 1).when(before.rlike(MEASURED), -1).otherwise(0)
    form = F.when(bare & (count < 9), -1).when(number.rlike(r"^(.)\1*$"), -1).when(hit.rlike(r"[0-9a-fA-F]{16,}"), 1).otherwise(0)
    checksum = F.when(count.between(13, 19) & F.lit(kind in ("card", "number_like")), F.when(passes_luhn(number), 1).otherwise(-1)).otherwise(0)

    def neighbour(c: Column) -> Column:
        return F.when(c == "", "end").when(c.rlike(r"\s"), "blank").when(c.rlike(r"[\p{L}\p{N}]"), "word").otherwise("mark")

    features = [
        F.lit(kind), F.when(count < 7, "few").when(count < 9, "7-8").when(count < 13, "9-12").when(count < 20, "13-19").otherwise("more"),
        F.when(hit.rlike(r"[0-9][ ().-]+[0-9]"), "parts").otherwise("one"), neighbour(F.right(before, F.lit(1))), neighbour(F.left(s["after"], F.lit(1))),
    ]
    votes = [shape, gazetteer, context, form, checksum]
    return F.struct(
        *(v.cast("int").alias(n) for v, n in zip(votes, LABELERS, strict=True)),
        *(f.alias(n) for f, n in zip(features, FEATURES, strict=True)),
    )


def estimate(rows: list[tuple[tuple[int, ...], float]]) -> tuple[list[float], list[list[dict[int, float]]]]:
    """Expectation-maximisation over ``(votes, count)``: P(personal) per row, and P(vote | class) per labeler and class."""
    belief = [1 / (1 + math.exp(-sum(votes))) for votes, _ in rows]
    tables: list[list[dict[int, float]]] = []
    for _ in range(ROUNDS):
        total = sum(n for _, n in rows)
        prior = (sum(n * b for (_, n), b in zip(rows, belief, strict=True)) + 1) / (total + 2)
        tables = []
        for j in range(len(rows[0][0]) if rows else 0):
            seen = [{-1: 1.0, 0: 1.0, 1: 1.0}, {-1: 1.0, 0: 1.0, 1: 1.0}]
            for (votes, n), b in zip(rows, belief, strict=True):
                seen[0][votes[j]] += n * (1 - b)
                seen[1][votes[j]] += n * b
            tables.append([{v: c / sum(side.values()) for v, c in side.items()} for side in seen])
        odds = [
            math.log(prior / (1 - prior)) + sum(math.log(t[1][v] / t[0][v]) for t, v in zip(tables, votes, strict=True))
            for votes, _ in rows
        ]
        belief = [1 / (1 + math.exp(-max(-50.0, min(50.0, o)))) for o in odds]
    return belief, tables


def fit(docs: DataFrame) -> dict[str, dict[str, float]]:
    """Log-odds of personal data, for each feature and value, from the texts of all rows; ``{"": {"": prior}}`` besides."""
    found = docs.select(_all_matches(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("m"))
    described = found.select(
        F.explode(F.concat(*(F.transform(f"m.{k}", partial(_described, k)) for k in KINDS))).alias("d")
    )
    counted = described.select("d.*").groupBy(*LABELERS, *FEATURES).count().collect()  # at most MAX_COMBINATIONS rows
    counted.sort(key=lambda r: tuple(map(str, r)))
    by_votes: dict[tuple[int, ...], float] = {}
    for r in counted:
        votes = tuple(r[n] for n in LABELERS)
        by_votes[votes] = by_votes.get(votes, 0) + r["count"]
    belief, _ = estimate(list(by_votes.items()))
    personal = dict(zip(by_votes, belief, strict=True))
    sums: dict[str, dict[str, list[float]]] = {n: {} for n in FEATURES}
    whole = [1.0, 1.0]
    for r in counted:
        b = personal[tuple(r[n] for n in LABELERS)]
        for side, weight in ((0, 1 - b), (1, b)):
            whole[side] += weight * r["count"]
            for name in FEATURES:
                sums[name].setdefault(r[name], [1.0, 1.0])[side] += weight * r["count"]
    odds = {
        name: {value: math.log(s[1] / (whole[1] + len(values))) - math.log(s[0] / (whole[0] + len(values))) for value, s in values.items()}
        for name, values in sums.items()
    }
    return odds | {"": {"": math.log(whole[1] / whole[0])}}


def _is_sure(model: dict[str, dict[str, float]], kind: str, s: Column) -> Column:
    described = _described(kind, s)
    score = F.lit(model[""][""])
    for name in FEATURES:
        weight = reduce(lambda w, x: w.when(described[name] == x[0], x[1]), model[name].items(), F.when(F.lit(False), 0.0))
        score = score + weight.otherwise(0.0)
    return score >= math.log(SURE / (1 - SURE))


def find(docs: DataFrame, model: dict[str, dict[str, float]]) -> DataFrame:
    """``docs`` with ``found``: an array of ``(kind, start, end)`` in code points, base kinds as listed, then the others.

    Base spans may overlap across kinds.  A proposed span is added where the
    classifier is sure and no base span overlaps it.  A null text counts as
    empty and has no span.  Any other column of ``docs`` passes through; one
    named ``found`` is replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    carried = [F.col(f"`{c}`") for c in docs.columns if c != "found"]
    matched = docs.select(*carried, _all_matches(text).alias("found"))
    base = [F.filter(F.col("found")[k], partial(_is_base, k)).alias(k) for k in BASE]
    sure = [F.filter(F.col("found")[k], partial(_is_sure, model, k)).alias(k) for k in PROPOSED]
    checked = matched.select(*carried, F.struct(*base, *sure).alias("found"))

    def spans(kind: str) -> Column:
        own = F.col("found")[kind]
        if kind in PROPOSED:
            taken = F.concat(*(F.col("found")[k] for k in BASE))
            own = F.filter(own, lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.transform(own, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return checked.select(*carried, F.concat(*(spans(k) for k in KINDS)).alias("found"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def put(state: Column, s: Column) -> Column:
        tag = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        apart = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), tag)
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], apart).otherwise(state["out"]).alias("out")
        )

    done = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
