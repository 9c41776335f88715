"""Personal data by candidate gradient boosting, in DataFrame functions.

High-recall generators propose spans of four kinds, which may overlap. Each candidate has format and
context features. Spans that satisfy the fixed rules of their kind (the base) always stay, and so do
loose spans (national phones, 'name (at) host') whose format or context speaks for them. For the other
candidates a short series of boosted trees of depth two and a threshold per kind, calibrated on held-out
candidates, select further redactions.

The trees learn from a bounded sample, the candidates of the ``max_docs`` documents with the smallest hash
of their id. A strict candidate is labelled by the rules of its kind; a loose one is positive if format
or context speaks for it and otherwise has no label, so it is never a negative. The rules' own tests
(check digits, octets) are no features, so trees generalise by form and context. They are fitted on the
driver from a few thousand small rows and applied as CASE expressions.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.llm.names import free_name

KINDS = ("email", "ip", "card", "phone")
MAX_DOCS = 4000
MAX_CANDIDATES = 6000
PRECISION = 0.98
_LOCAL = "[A-Za-z0-9._%+-]"
# Possessive loops and the look-behind keep each search linear. \G admits a match right after the last one.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Forms beyond the rules. A phone of the base is matched first and left out, so no part of one is proposed.
_BASE_PHONE = r"\+[0-9](?:[\x20().-]*+[0-9]){9,14}+(?![\x20().-]*+[0-9])"
LOOSE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    "phone": _BASE_PHONE + r"|(?<![0-9+.(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CUES = "tel|phone|fon|call|mail|card|carte|karte|tarjeta|contact| ip"
#: Formats that speak for a loose candidate by themselves.
CLEAR = {"email": r"[A-Za-z]{2,}$", "phone": r"^(?:\([0-9]{3}\)|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$)"}
FEATURES = ("kind", "digits", "length", "marks", "before_word", "after_word", "cue", "groups", "lead")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def satisfies(kind: str, m: Column) -> Column:
    """The rules of a kind on a match of its pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(m))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(m))).otherwise(False)
    return (n >= 10) & (n <= 15)


def speaks_for(kind: str, c: Column) -> Column:
    """True if the format or the context of a loose candidate speaks for it, else null: no label."""
    alone = ~c["before"].rlike("[\\p{L}0-9_]$") & ~c["after"].rlike("^[\\p{L}0-9_]")
    return F.when(F.lower(c["before"]).rlike(_CUES) | (alone & c["m"].rlike(CLEAR[kind])), F.lit(True))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<start, end, m, before, after>> of all matches, leftmost and non-overlapping.

    Positions are code points, end exclusive, from the lengths of the pieces between the matches. Running
    sums go through blocks of 64 matches, so a text of many thousand matches stays cheap.
    """
    width = 64
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))

    def rows(s: Column) -> Column:
        n = F.size(s["found"])
        paired = F.zip_with(s["found"], F.slice(s["pieces"], F.lit(1), n), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
        return F.zip_with(
            paired, F.slice(s["pieces"], F.lit(2), n),
            lambda x, q: F.struct(
                x["m"].alias("m"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"),
                F.right(x["p"], F.lit(24)).alias("before"), F.left(q, F.lit(1)).alias("after"),
            ),
        )

    def placed(z: Column, lengths: Column, offsets: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            b = F.floor(i / width).cast("int")
            ahead = F.element_at(offsets, b + 1) + _sum(F.slice(lengths, b * width + 1, i % width))
            start = ahead + x["gap"]
            return F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))

        return F.transform(z, place)

    def located(z: Column) -> Column:
        def with_lengths(lengths: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / width).cast("int"))
            sums = F.transform(blocks, lambda b: _sum(F.slice(lengths, b * width + 1, F.lit(width))))
            return _let(sums, lambda s: _let(F.transform(s, lambda x, b: _sum(F.slice(s, F.lit(1), b))), lambda o: placed(z, lengths, o)))

        return _let(F.transform(z, lambda x: x["gap"] + x["size"]), with_lengths)

    empty = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    some = possible & text.rlike(pattern)
    return F.when(some, _let(both, lambda s: _let(rows(s), located))).otherwise(empty)


def _proposals(text: Column) -> list[Column]:
    """A candidate array per generator, each candidate with its features, whether the rules hold, and its label."""
    has = {"email": text.contains("@"), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    loose_has = {"email": text.contains("at)") | text.contains("at]"), "phone": text.rlike("[0-9]{3}[\\x20.-][0-9]{4}")}
    out = []
    for patterns, possible, strict in ((PATTERNS, has, True), (LOOSE, loose_has, False)):
        for kind, pattern in patterns.items():
            found = matches(text, pattern, possible[kind])
            # Short digit runs are no candidates for cards.
            if kind == "card":
                found = F.filter(found, lambda c: F.length(_digits(c["m"])) >= 12)
            if kind == "phone" and not strict:
                found = F.filter(found, lambda c: ~c["m"].startswith("+"))
            out.append(F.transform(found, _candidate(kind, strict)))
    return out


def _candidate(kind: str, strict: bool):
    def describe(c: Column) -> Column:
        m = c["m"]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            c["start"].alias("start"),
            c["end"].alias("end"),
            (satisfies(kind, m) if strict else F.lit(False)).alias("base"),
            (satisfies(kind, m) if strict else speaks_for(kind, c)).alias("label"),
            F.length(_digits(m)).alias("digits"),
            F.length(m).alias("length"),
            F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")).alias("marks"),
            c["before"].rlike("[\\p{L}0-9\"=]$").cast("int").alias("before_word"),
            c["after"].rlike("^[\\p{L}0-9\"]").cast("int").alias("after_word"),
            F.lower(c["before"]).rlike(_CUES).cast("int").alias("cue"),
            F.length(F.regexp_replace(F.regexp_replace(m, "[0-9]++", "0"), "[^0]", "")).alias("groups"),
            F.coalesce(F.substring(_digits(m), 1, 1).try_cast("int"), F.lit(-1)).alias("lead"),
        )

    return describe


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a last array column ``pii_candidates``; a null text has none."""
    return docs.select("*", F.concat(*_proposals(F.coalesce(F.col(text), F.lit("")))).alias(free_name(docs, "pii_candidates")))


# --- boosted trees ---------------------------------------------------------------------------


def _best_split(rows, grad, hess, members):
    """(gain, feature, threshold) of the best split of ``members``; None if nothing gains."""
    best = None
    g, h = sum(grad[i] for i in members), sum(hess[i] for i in members)
    score = lambda a, b: a * a / (b + 1.0)
    for f in range(len(FEATURES)):
        by_value: dict[float, list[float]] = {}
        for i in members:
            s = by_value.setdefault(rows[i][f], [0.0, 0.0])
            s[0] += grad[i]
            s[1] += hess[i]
        a = b = 0.0
        values = sorted(by_value)
        for v, after in zip(values, values[1:]):
            a, b = a + by_value[v][0], b + by_value[v][1]
            gain = score(a, b) + score(g - a, h - b) - score(g, h)
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = (gain, f, (v + after) / 2)
    return best


def _grow(rows, grad, hess, members, depth):
    split = _best_split(rows, grad, hess, members) if depth else None
    if split is None:
        return 0.3 * sum(grad[i] for i in members) / (sum(hess[i] for i in members) + 1.0)
    _, f, t = split
    return (
        f, t,
        _grow(rows, grad, hess, [i for i in members if rows[i][f] <= t], depth - 1),
        _grow(rows, grad, hess, [i for i in members if rows[i][f] > t], depth - 1),
    )


def leaf(tree, row) -> float:
    while isinstance(tree, tuple):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def fit_trees(rows: list[tuple], labels: list[int], rounds: int = 24) -> list:
    """Gradient boosting of the logistic loss with trees of depth two."""
    score = [0.0] * len(rows)
    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _grow(rows, [y - q for y, q in zip(labels, p)], [q * (1 - q) for q in p], range(len(rows)), 2)
        trees.append(tree)
        score = [s + leaf(tree, r) for s, r in zip(score, rows)]
    return trees


def calibrated(trees: list, rows: list[tuple], labels: list[int], precision: float = PRECISION) -> dict[int, float]:
    """Per kind the lowest score from which held-out candidates reach the precision; none: infinity."""
    cuts = {}
    for kind in range(len(KINDS)):
        scored = sorted(((sum(leaf(t, r) for t in trees), y) for r, y in zip(rows, labels) if r[0] == kind), reverse=True)
        cut, hits = math.inf, 0
        for n, (s, y) in enumerate(scored, 1):
            hits += y
            last = n == len(scored) or scored[n][0] < s
            if last and n >= 20 and hits >= precision * n:
                cut = s
        cuts[kind] = cut
    return cuts


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> tuple[list, dict[int, float]]:
    """(trees, cuts); with too few labelled candidates no tree and nothing selected by one."""
    picked = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id", "left_semi")
    found = candidates(sample).select("doc_id", F.explode("pii_candidates").alias("c")).where("c.label IS NOT NULL")
    found = found.select("doc_id", "c.*").orderBy(F.xxhash64("doc_id", "start", "kind"), "doc_id", "start", "kind", "end").limit(MAX_CANDIDATES)
    got = found.collect()
    rows = [tuple(float(r[f]) for f in FEATURES) for r in got]
    labels = [int(r["label"]) for r in got]
    held = random.Random(5)
    part = [held.random() < 0.3 for _ in rows]
    fit = [i for i, h in enumerate(part) if not h]
    if len(fit) < 50 or len({labels[i] for i in fit}) < 2:
        return [], dict.fromkeys(range(len(KINDS)), math.inf)
    trees = fit_trees([rows[i] for i in fit], [labels[i] for i in fit])
    rest = [i for i, h in enumerate(part) if h]
    return trees, calibrated(trees, [rows[i] for i in rest], [labels[i] for i in rest])


def _tree_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, t, low, high = tree
    return F.when(c[FEATURES[f]] <= t, _tree_column(low, c)).otherwise(_tree_column(high, c))


def accepted(trees: list, cuts: dict[int, float], c: Column) -> Column:
    """Whether the trees select a candidate."""
    ok = F.lit(False)
    if trees:
        score = sum((_tree_column(t, c) for t in trees[1:]), _tree_column(trees[0], c))
        for kind, cut in cuts.items():
            if math.isfinite(cut):
                ok = ok | ((c["kind"] == kind) & (score >= cut))
    return ok


def personal_data(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` with array columns ``pii_base`` and ``pii_spans`` of (start, kind, end), both sorted; where
    ``docs`` has such columns, the new ones get the first free names after these.

    pii_base are the spans of the fixed rules, pii_spans those, the loose ones that format or context speaks
    for and the ones that the trees select. A null or empty text has none; repeated rows get equal spans; an empty table gives an empty result. Apart
    from the sample, which only learns, this is one scan without a shuffle.
    """
    trees, cuts = train(docs, max_docs)
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    proposed = F.col(free_name(docs, "pii_candidates"))
    base = F.array_sort(F.transform(F.filter(proposed, lambda c: c["base"]), span))
    every = F.filter(proposed, lambda c: c["base"] | F.coalesce(c["label"], F.lit(False)) | accepted(trees, cuts, c))
    return candidates(docs).select(
        *docs.columns,
        base.alias(free_name(docs, "pii_base")),
        F.array_sort(F.array_distinct(F.transform(every, span))).alias(free_name(docs, "pii_spans")),
    )


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def redact(text: Column, spans: Column) -> Column:
    """The text with spans replaced by [KIND]; overlapping spans become one, named by the first."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        out = F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    whole = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, whole)).otherwise(text)
