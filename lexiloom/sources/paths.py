"""Glob predicates and prioritised path filters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Directories left out unless a rule brings them back.
DEFAULT_EXCLUDES = ("node_modules", ".git", "target", "dist", "build", "_build")


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob with *, **, ? and [..]."""
    out, i = ["^"], 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append("\\" + ch if ch in r".^$+(){}|\[]" else ch)
        i += 1
    return "".join(out) + "$"


def glob_expression(pattern: Column) -> Column:
    """The regular expression, without anchors, of a glob that is itself a column."""
    quoted = F.regexp_replace(pattern, r"([.^$+(){}|\\])", r"\\$1")
    marked = F.replace(F.replace(quoted, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02"))
    single = F.replace(F.replace(marked, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    whole = F.replace(F.replace(single, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*"))
    return F.replace(whole, F.lit("[!"), F.lit("[^"))


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def in_scope(path: Column, scope: str) -> Column:
    """The path equals the scope, lies below it, or matches it as a glob."""
    if any(c in scope for c in "*?["):
        return glob_match(path, scope)
    base = scope.rstrip("/")
    return (path == base) | F.startswith(path, F.lit(base + "/"))


def first_rule(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Target of the first rule (glob, target) that matches. Rules are configuration, hence a CASE."""
    chosen = F.lit(default)
    for pattern, target in reversed(rules):
        chosen = F.when(glob_match(path, pattern), target).otherwise(chosen)
    return chosen


def should_include(
    path: Column,
    excludes: list[str] = (),
    includes: list[str] = (),
    ignore_lines: list[str] = (),
    default_excludes: tuple[str, ...] = DEFAULT_EXCLUDES,
) -> Column:
    """Exclude beats include beats the ignore file (its last match decides) beats the defaults."""
    verdict = F.lit(True)
    for name in default_excludes:
        verdict = F.when(path.rlike(f"(^|/){name.replace('.', chr(92) + '.')}(/|$)"), False).otherwise(verdict)
    for line in ignore_lines:
        keep = line.startswith("!")
        pattern = line.lstrip("!").rstrip("/")
        full = pattern.lstrip("/") if pattern.startswith("/") else "**/" + pattern
        hit = glob_match(path, full) | glob_match(path, full + "/**")
        verdict = F.when(hit, keep).otherwise(verdict)
    for pattern in includes:
        verdict = F.when(glob_match(path, pattern), True).otherwise(verdict)
    for pattern in excludes:
        verdict = F.when(glob_match(path, pattern), False).otherwise(verdict)
    return verdict
