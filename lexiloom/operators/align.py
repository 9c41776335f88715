"""Requirements against implementations, and documentation against code units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexiloom.functions import hashing, text as tx
from lexiloom.operators import prefix as px


def literal_overlaps(required: DataFrame, evidence: DataFrame) -> DataFrame:
    """(lid, rid, overlap): share of a requirement's literals an item holds, from two hits on.

    Both inputs are distinct (id, literal); ``evidence`` may spell a number in hexadecimal.
    """
    wanted = required.withColumn("needed", F.count(F.lit(1)).over(W.partitionBy("id")))
    hits = wanted.toDF("lid", "literal", "needed").join(evidence.toDF("rid", "literal"), "literal")
    counts = hits.groupBy("lid", "rid", "needed").agg(F.count(F.lit(1)).alias("hits")).where("hits >= 2")
    return counts.select("lid", "rid", F.round(F.col("hits") / F.col("needed"), 6).alias("overlap"))


def pair_overlaps(required: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, overlap): share of a requirement's (label, literal) pairs found on one evidence line.

    A line counts when it names the label, or an identifier that carries the label. Inputs:
    required (id, label, literal), evidence (id, line_no, word, literal) with one row per word
    and literal of a line.
    """
    wanted = required.distinct()
    direct = evidence.select("id", F.col("word").alias("label"), "literal")
    parts = F.explode(F.split(tx.identifier_words(F.col("word")), " "))
    carried = evidence.where(F.col("word").rlike("[-_A-Z]")).select("id", parts.alias("label"), "literal")
    present = direct.unionByName(carried).distinct().withColumn("found", F.lit(1))
    both = wanted.join(present, ["id", "label", "literal"], "left")
    return both.groupBy("id").agg(F.round(F.coalesce(F.sum("found"), F.lit(0)) / F.count(F.lit(1)), 6).alias("overlap"))


# Trace settings.
MIN_EDGES = 10
LOWEST_THRESHOLD = 0.08
CLEAR_GAP = 0.05


def lowest_limit(threshold: float) -> float:
    """The limit of a requirement whose best edge is clearly ahead."""
    return max(threshold * 0.5, LOWEST_THRESHOLD)


def trace_edges(scores: DataFrame, threshold: float) -> DataFrame:
    """(lid, rid, score, rank, limit, status): the ten best edges per requirement and all above its limit.

    The limit is the threshold, lowered when the best edge is clearly ahead of the second.
    """
    group = W.partitionBy("lid")
    best_two = scores.groupBy("lid").agg(F.max("score").alias("top1"))
    ranked = scores.withColumn("rank", F.row_number().over(group.orderBy(F.desc("score"), "rid")))
    second = ranked.where("rank = 2").select("lid", F.col("score").alias("top2"))
    lowered = lowest_limit(threshold)
    gap = F.round(F.col("top1") - F.coalesce("top2", F.lit(0.0)), 6)
    limit = F.when(
        (F.col("top1") < threshold) & (F.col("top1") >= lowered) & (gap >= CLEAR_GAP), F.lit(lowered)
    ).otherwise(F.lit(threshold))
    limits = best_two.join(second, "lid", "left").select("lid", limit.alias("limit"))
    # Edges that can be kept: the first ten, or those that reach the lowest possible limit.
    few = ranked.where((F.col("rank") <= MIN_EDGES) | (F.col("score") >= lowered)).join(limits, "lid")
    kept = few.where((F.col("rank") <= MIN_EDGES) | (F.col("score") >= F.col("limit")))
    return kept.withColumn("status", F.when(F.col("score") >= F.col("limit"), "matched").otherwise("unmatched"))


def preferred_match(edges: DataFrame, missing: DataFrame) -> DataFrame:
    """One edge per requirement: fewest missing pairs, then literals, then confidence, then rank.

    ``missing``: (lid, rid, missing_pairs, missing_literals); absent rows miss nothing.
    """
    both = edges.join(missing, ["lid", "rid"], "left").fillna(0, ["missing_pairs", "missing_literals"])
    order = W.partitionBy("lid").orderBy(
        (F.col("status") != "matched").cast("int"), "missing_pairs", "missing_literals", F.desc("score"), "rank"
    )
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def diff_items(requirements: DataFrame, preferred: DataFrame, previous: DataFrame, changed: DataFrame) -> DataFrame:
    """(lid, rid, category, score) for each requirement.

    ``previous``: (lid, rid, score) of the last snapshot; ``changed``: (lid) whose both sides
    changed since. ``preferred`` carries type_only and file_has_logic flags of the match.
    """
    old = previous.select("lid", F.col("rid").alias("old_rid"), F.col("score").alias("old_score"))
    moved = changed.select("lid").distinct().withColumn("both_changed", F.lit(True))
    rows = requirements.select("lid").join(preferred, "lid", "left").join(old, "lid", "left").join(moved, "lid", "left")
    drop = F.when(F.col("old_rid") == F.col("rid"), F.round(F.col("old_score") - F.col("score"), 6)).otherwise(0.0)
    drifted = (F.col("missing_literals") > 0) | (F.col("missing_pairs") > 0) | (drop >= 0.3)
    category = (
        F.when(F.col("rid").isNull() | (F.col("status") != "matched"), "SPEC_ONLY")
        .when(drifted & F.coalesce("both_changed", F.lit(False)), "CONFLICT")
        .when(drifted, "DRIFTED")
        .when(F.col("type_only") & ~F.col("file_has_logic"), "SHALLOW")
        .otherwise("MATCHED")
    )
    return rows.select("lid", "rid", category.alias("category"), F.coalesce("score", F.lit(0.0)).alias("score"))


def implementation_only(implementations: DataFrame, edges: DataFrame) -> DataFrame:
    """Implementations (rid) without any matched edge."""
    return implementations.select("rid").join(edges.where("status = 'matched'").select("rid").distinct(), "rid", "left_anti")


SEVERITY = {"CONFLICT": "error", "DRIFTED": "warning", "SPEC_ONLY": "warning", "SHALLOW": "info", "IMPL_ONLY": "info"}


def suggestions(items: DataFrame, direction: str) -> DataFrame:
    """(lid, rid, suggestion) without repeats. ``direction``: spec, impl or both."""
    impl = F.when(F.col("category") == "SPEC_ONLY", "implement").when(F.col("category").isin("DRIFTED", "CONFLICT"), "update_implementation")
    spec = F.when(F.col("category") == "IMPL_ONLY", "document").when(F.col("category").isin("DRIFTED", "CONFLICT"), "update_spec")
    chosen = {"impl": F.array(impl), "spec": F.array(spec), "both": F.array(impl, spec)}[direction]
    rows = items.select("lid", "rid", F.explode(chosen).alias("suggestion")).where("suggestion IS NOT NULL")
    return rows.dropDuplicates(["lid", "rid", "suggestion"])


def category_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("items"))


def should_fail(items: DataFrame, categories: list[str]) -> DataFrame:
    """One row (fail): whether any item falls into one of the categories."""
    return items.agg(F.coalesce(F.bool_or(F.col("category").isin(*categories)), F.lit(False)).alias("fail"))


def contiguous_groups(units: DataFrame) -> DataFrame:
    """Adds ``group_start``: first line of the run of touching units of one file and kind.

    Units are scanned range by range, so a file of any size is spread over tasks.
    """
    group, order = ["file", "kind"], ["start_line", "end_line", "id"]
    reached = px.running_max(px.ranged(units, group, order), group, order, F.col("end_line"), "_reached", inclusive=False)
    fresh = F.col("_reached").isNull() | (F.col("start_line") > F.col("_reached") + 1)
    # Lines ascend, so the last start of a run is the largest so far.
    marked = px.running_max(reached, group, order, F.when(fresh, F.col("start_line")), "group_start")
    return marked.drop("_reached", "_rng")


# Confidence of each way a text names a unit.
MATCH_SCORES = {"qualified_dot": 100, "qualified_colon": 95, "inline_symbol": 92, "symbol_name": 85, "file_name": 45}


def unit_keys(units: DataFrame) -> DataFrame:
    """(unit, key, score) of units (unit, name, ns, base)."""
    name, ns = tx.ascii_lower(F.col("name")), tx.ascii_lower(F.col("ns"))

    def entry(key: Column, kind: str, when: Column) -> Column:
        return F.when(when, F.struct(key.alias("key"), F.lit(MATCH_SCORES[kind]).alias("score")))

    has_ns = F.coalesce(F.col("ns") != "", F.lit(False))
    keys = F.array(
        entry(F.concat(ns, F.lit("."), name), "qualified_dot", has_ns),
        entry(F.concat(ns, F.lit("::"), name), "qualified_colon", has_ns),
        entry(F.concat(F.lit("`"), name, F.lit("`")), "inline_symbol", F.lit(True)),
        entry(name, "symbol_name", F.lit(True)),
        entry(F.concat(F.lit("file:"), tx.ascii_lower(F.col("base"))), "file_name", F.coalesce(F.col("base") != "", F.lit(False))),
    )
    return units.select("unit", F.explode(keys).alias("k")).where("k IS NOT NULL").select("unit", "k.key", "k.score")


ATOM_BREAKS = r"[^a-z0-9_#.:`\-\x{c0}-\x{ff}]+"


def fragment_keys(fragments: DataFrame, max_words: int = 1) -> DataFrame:
    """(key, fragment): the first fragment that holds a key; fragments (fragment, text).

    Keys are runs of up to ``max_words`` words as written, with the dots, colons and backticks that join or
    enclose them, and the same without backticks; single words also stand for file names. Equal texts
    have equal keys, so the first fragment of each text stands for the rest. Only the
    first fragment is needed for a best match, and it is found map-side, so a word that fills the
    corpus stays one row.
    """
    fragments = fragments.where("text IS NOT NULL").groupBy("text").agg(F.min("fragment").alias("fragment"))

    def runs(atoms: Column) -> Column:
        lengths = F.array(*(F.lit(n) for n in range(1, max_words + 1)))
        starts = lambda n: F.when(F.size(atoms) >= n, F.sequence(F.lit(1), F.size(atoms) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(lengths, lambda n: F.transform(starts(n), lambda i: F.array_join(F.slice(atoms, i, n), " "))))

    trimmed = F.transform(F.split(tx.ascii_lower(F.col("text")), ATOM_BREAKS), lambda a: F.regexp_replace(a, r"^[.:\-]+|[.:\-]+$", ""))
    rows = fragments.select("fragment", F.filter(trimmed, lambda a: a != "").alias("atoms"))
    plain = F.filter(F.transform("atoms", lambda a: F.replace(a, F.lit("`"))), lambda a: a != "")
    rows = rows.select("fragment", "atoms", plain.alias("plain"))
    files = F.transform("plain", lambda a: F.concat(F.lit("file:"), a))
    keys = F.array_distinct(F.concat(runs(F.col("atoms")), runs(F.col("plain")), files))
    return rows.select("fragment", F.explode(keys).alias("key")).groupBy("key").agg(F.min("fragment").alias("fragment"))


def best_fragment(units: DataFrame, fragments: DataFrame) -> DataFrame:
    """(unit, fragment, score): the strongest match per unit, the first fragment on a tie.

    Sizes of files say little of keys cut from them, so the join is told not to broadcast.
    """
    longest = units.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    met = unit_keys(units).hint("merge").join(fragment_keys(fragments, longest).hint("merge"), "key")
    best = met.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("neg"), "fragment")).alias("m"))
    return best.select("unit", F.col("m.fragment").alias("fragment"), (-F.col("m.neg")).alias("score"))


def covered_modules(module_tokens: DataFrame, fragment_tokens: DataFrame) -> DataFrame:
    """(module): some fragment shares two tokens with it, one of them specific.

    Inputs distinct: (module, token) and (fragment, token). Equal token sets are one; each distinct pair of a
    specific and another token of a set asks the modules of the token that fewer modules use, so a number
    that names one part meets one module, however many words stand beside it somewhere. No side is broadcast,
    as for ``best_fragment``.
    """
    uses = module_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    held = fragment_tokens.join(uses.hint("merge"), "token").groupBy("fragment").agg(F.sort_array(F.collect_list(F.struct("token", "uses"))).alias("held"))
    sets = held.where(F.size("held") > 1).select("held").distinct()
    pairs = sets.select("held", F.explode("held").alias("x")).where(tx.is_specific_token(F.col("x.token"))).select("x", F.explode("held").alias("y"))
    rarer = F.col("x.uses") <= F.col("y.uses")
    asked = pairs.where("x.token <> y.token").select(
        F.when(rarer, F.col("x.token")).otherwise(F.col("y.token")).alias("token"), F.when(rarer, F.col("y.token")).otherwise(F.col("x.token")).alias("other")
    )
    met = asked.distinct().join(module_tokens.select("module", "token").hint("merge"), "token").select("module", F.col("other").alias("token"))
    return met.distinct().join(module_tokens.hint("merge"), ["module", "token"], "left_semi").select("module").distinct()


def time_relation(code_time: Column, doc_time: Column, tolerance: int) -> Column:
    gap = code_time - doc_time
    return (
        F.when(code_time.isNull() | doc_time.isNull(), "unknown")
        .when(F.abs(gap) <= tolerance, "in_sync")
        .when(gap > 0, "doc_older")
        .otherwise("doc_newer")
    )


def match_status(relation: Column, score: Column) -> Column:
    trusted = (score >= 85) & (score != MATCH_SCORES["file_name"])
    return (
        F.when(relation == "doc_older", "stale_doc")
        .when((relation == "doc_newer") & trusted, "in_sync")
        .when(relation == "doc_newer", "review_both")
        .when(score < 80, "review_mapping")
        .otherwise("in_sync")
    )


def aggregate_suggestions(candidates: DataFrame) -> DataFrame:
    """(scope, path, status, candidates): modules with two or more, projects with three or more over two modules."""
    modules = candidates.groupBy(F.col("module").alias("path"), "status").agg(F.count(F.lit(1)).alias("candidates"))
    per = candidates.groupBy("project", "module", "status").agg(F.count(F.lit(1)).alias("n"))
    projects = per.groupBy(F.col("project").alias("path"), "status").agg(
        F.sum("n").alias("candidates"), F.count("module").alias("modules")
    )
    return (
        modules.where("candidates >= 2")
        .select(F.lit("module").alias("scope"), "path", "status", "candidates")
        .unionByName(
            projects.where("candidates >= 3 AND modules >= 2").select(F.lit("project").alias("scope"), "path", "status", "candidates")
        )
    )


def uncovered_candidates(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidates that no module or project suggestion stands for."""
    for scope, key in (("module", "module"), ("project", "project")):
        named = groups.where(F.col("scope") == scope).select(F.col("path").alias(key), "status")
        candidates = candidates.join(named, [key, "status"], "left_anti")
    return candidates


def snapshot_history(runs: DataFrame) -> DataFrame:
    """(run, fingerprint): the entries kept when an unchanged fingerprint replaces the last one.

    ``runs``: (series, run, fingerprint) in order of run; the last run of each stretch stays.
    """
    group, order = ["series"], ["run"]
    known = px.following(px.ranged(runs, group, order), group, order, "fingerprint", "_n")
    return known.where(F.col("_n").isNull() | (F.col("_n") != F.col("fingerprint"))).drop("_n", "_rng")


def candidate_digest(*cols: str) -> Column:
    return hashing.content_hash(F.concat_ws("|", *cols))
