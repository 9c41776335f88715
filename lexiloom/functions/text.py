"""Tokenisers and string functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The character sets of the token definitions.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD_PATTERN = r"[a-z0-9_\-\x{c0}-\x{ff}]{2,}"
VOCAB_PATTERN = r"[A-Za-z0-9_]+"
TRAINING_PATTERN = r"[A-Za-z0-9]+"
NORMATIVE_WORDS = ("SHALL", "MUST", "SHOULD")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def matches(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def normalize_text(col: Column) -> Column:
    """ASCII lower case, blank runs to one space, no blanks at the ends."""
    return F.trim(F.regexp_replace(ascii_lower(col), r"[ \t\n\r]+", " "))


def word_tokens(col: Column) -> Column:
    """Runs of two or more word characters; CJK text yields none."""
    return matches(ascii_lower(col), WORD_PATTERN)


def character_bigrams(col: Column) -> Column:
    """Overlapping two-character strings of the text without blanks."""
    packed = F.regexp_replace(ascii_lower(col), r"[ \t\n\r]+", "")
    # A look-ahead walks the text once; substring() per position would be quadratic.
    return (
        F.when(F.char_length(packed) == 0, F.array().cast("array<string>"))
        .when(F.char_length(packed) == 1, F.array(packed))
        .otherwise(matches(packed, r"(?s)(?=(..))", 1))
    )


def similarity_tokens(col: Column) -> Column:
    """Words, or character bigrams for a text without words."""
    words = word_tokens(col)
    return F.when(F.size(words) > 0, words).otherwise(character_bigrams(col))


def vocabulary_words(col: Column, min_length: int = 3) -> Column:
    found = F.transform(matches(col, VOCAB_PATTERN), ascii_lower)
    return F.filter(found, lambda w: F.char_length(w) >= min_length)


def training_words(col: Column, min_length: int = 2) -> Column:
    found = F.transform(matches(col, TRAINING_PATTERN), ascii_lower)
    return F.filter(found, lambda w: F.char_length(w) >= min_length)


def canonical_word(word: Column) -> Column:
    """Plural ending removed: -ies to -y, -es after a sibilant, a final -s but not -ss."""
    size = F.char_length(word)
    return (
        F.when((size > 5) & word.rlike("ies$"), F.regexp_replace(word, "ies$", "y"))
        .when((size > 5) & word.rlike("(sses|ches|shes|xes|zes)$"), F.regexp_replace(word, "es$", ""))
        .when((size > 4) & word.rlike("[^s]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def task_token_stream(col: Column) -> Column:
    """Each query word and its parts around - and _, in canonical form, repeats kept."""
    def spread(word: Column) -> Column:
        parts = F.filter(F.split(word, "[-_]"), lambda p: p != "")
        return F.transform(F.concat(F.array(word), parts), canonical_word)

    stream = F.flatten(F.transform(word_tokens(col), spread))
    return F.filter(stream, lambda w: F.char_length(w) >= 2)


def task_tokens(col: Column) -> Column:
    return F.array_distinct(task_token_stream(col))


def feature_kind(col: Column) -> Column:
    return F.when(F.instr(col, ":") > 0, F.substring_index(col, ":", 1)).otherwise(col)


def feature_value(col: Column) -> Column:
    return F.when(F.instr(col, ":") > 0, F.regexp_replace(col, "^[^:]*:", "")).otherwise(F.lit(""))


def has_feature_value(col: Column) -> Column:
    return F.instr(col, ":") > 0


def is_specific_token(col: Column) -> Column:
    """Tokens that tell items apart: with a separator, with a digit, or five characters long."""
    size = F.char_length(col)
    return (
        (size >= 2)
        & ~col.rlike("^[0-9]+$")
        & (col.rlike(r"[-_.]") | ((size < 5) & col.rlike("[0-9]")) | (size >= 5))
    )


def specific_tokens(col: Column) -> Column:
    """The token and, for a plural, its singular, as far as they are specific."""
    word = trim_blanks(ascii_lower(col))
    stem = F.regexp_replace(word, "s$", "")
    both = F.when(word.rlike("s$") & (F.char_length(word) >= 5), F.array(word, stem)).otherwise(F.array(word))
    return F.when(is_specific_token(word), F.filter(both, is_specific_token)).otherwise(
        F.array().cast("array<string>")
    )


def is_integer_text(col: Column) -> Column:
    return col.rlike(r"^-?[0-9]+$")


def is_numeric_text(col: Column) -> Column:
    return col.rlike(r"^[0-9.,_-]*$")


def text_lines(col: Column) -> Column:
    """Lines without carriage returns and without an empty last line."""
    parts = F.split(F.replace(col, F.lit("\r"), F.lit("")), "\n", -1)
    ends_blank = F.element_at(parts, -1) == ""
    return F.when(ends_blank, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trim_blanks(col: Column) -> Column:
    return F.regexp_replace(col, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def join_with_limit(values: Column, limit: int) -> Column:
    shown = F.array_join(F.slice(values, 1, limit), ", ")
    extra = F.size(values) - limit
    return F.when(extra > 0, F.concat(shown, F.lit(" (+"), extra.cast("string"), F.lit(" more)"))).otherwise(shown)


def merge_unique(target: Column, values: Column) -> Column:
    fresh = F.filter(F.array_except(values, target), lambda v: v != "")
    return F.concat(target, fresh)


def identifier_words(col: Column) -> Column:
    spaced = F.translate(col, "_-", "  ")
    return F.lower(F.regexp_replace(spaced, r"([a-z0-9])([A-Z])", "$1 $2"))


def normative_strength(col: Column) -> Column:
    """First normative word that occurs, in order of strength."""
    upper = F.upper(col)
    chosen = F.lit("NONE")
    for word in reversed(NORMATIVE_WORDS):
        chosen = F.when(F.contains(upper, F.lit(word)), F.lit(word)).otherwise(chosen)
    return chosen


SECTION_RUN = (
    r"(?<![0-9a-z.])sections?(?![0-9a-z.])((?:[^0-9a-z.]+(?:[0-9.]*[0-9][0-9.]*|and|or|sections?)(?![0-9a-z.]))*)"
)


def section_references(col: Column) -> Column:
    """Section numbers named in a text ("section 3.1", "sections 4 and 5.2.")."""
    runs = matches(ascii_lower(col), SECTION_RUN, 1)
    numbers = F.flatten(F.transform(runs, lambda r: matches(r, r"[0-9.]*[0-9][0-9.]*")))
    return F.array_distinct(F.transform(numbers, lambda n: F.regexp_replace(n, r"\.+$", "")))


def section_reference_score(left: Column, right: Column) -> Column:
    """0.45 for a shared section number, 0.24 for a parent or child, else 0."""
    related = F.exists(
        left,
        lambda a: F.exists(
            right,
            lambda b: F.startswith(b, F.concat(a, F.lit("."))) | F.startswith(a, F.concat(b, F.lit("."))),
        ),
    )
    return F.when(F.arrays_overlap(left, right), 0.45).when(related, 0.24).otherwise(0.0)


def text_literals(col: Column) -> Column:
    """Digit runs of two or more and back-quoted passages."""
    return F.array_distinct(F.concat(matches(col, r"[0-9]{2,}"), matches(col, r"`([^`\n]+)`", 1)))


def literal_present(text: Column, literal: Column) -> Column:
    """The literal itself, in any case, or its hexadecimal form."""
    number = F.when(literal.rlike(r"^[0-9]{1,18}$"), literal.cast("bigint"))
    hexed = F.concat(F.lit("0x"), F.lower(F.hex(number)))
    lowered = F.lower(text)
    return F.contains(lowered, F.lower(literal)) | F.coalesce(F.contains(lowered, hexed), F.lit(False))


def literal_overlap(text: Column, literals: Column) -> Column:
    hits = F.size(F.filter(literals, lambda x: literal_present(text, x)))
    return F.when(hits < 2, 0.0).otherwise(hits / F.size(literals))


def inline_code(col: Column) -> Column:
    return F.array_distinct(matches(col, r"`([^`\n]+)`", 1))


def identifier_match_score(name: Column, body: Column, identifiers: Column) -> Column:
    """0 without a hit, else 0.3 plus 0.2 times the share of identifiers found."""
    lowered_name = F.concat_ws("\n", ascii_lower(name), identifier_words(name))
    lowered_body = ascii_lower(body)

    def found(identifier: Column) -> Column:
        wanted = ascii_lower(identifier)
        plain = F.regexp_replace(wanted, "[^a-z0-9]", "")
        return (
            F.contains(lowered_name, wanted)
            | F.contains(lowered_body, wanted)
            | ((F.char_length(plain) > 1) & F.contains(lowered_body, plain))
        )

    hits = F.size(F.filter(identifiers, found))
    return F.when(hits == 0, 0.0).otherwise(0.3 + 0.2 * hits / F.size(identifiers))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def extension(path: Column) -> Column:
    """Extension with its dot; a final dot alone is none."""
    return F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


def scope_terms(path: Column) -> Column:
    """Distinct stems of the path segments."""
    segments = F.filter(F.split(path, r"[/\\]"), lambda p: p != "")
    stems = F.transform(segments, lambda p: F.regexp_replace(p, r"\.[^.]+$", ""))
    return F.array_distinct(F.filter(stems, lambda p: p != ""))


FILENAME_INVALID = r'[()&:*?"<>|\\]'


def title_to_slug(col: Column) -> Column:
    """Lower case, blanks and slashes to hyphens, characters not allowed in file names dropped."""
    return ascii_lower(F.regexp_replace(F.translate(col, " /", "--"), FILENAME_INVALID, ""))


def slug_to_id(col: Column) -> Column:
    return ascii_lower(col)


def slug_to_title(col: Column) -> Column:
    """Hyphens to blanks, the letter at the start of each part in upper case."""
    def capital(part: Column) -> Column:
        return F.concat(F.translate(F.substring(part, 1, 1), ASCII_LOWER, ASCII_UPPER), F.substring(part, F.lit(2), F.char_length(part)))

    def word(part: Column) -> Column:
        return F.array_join(F.transform(F.split(part, "/"), capital), "/")

    return F.array_join(F.transform(F.split(col, "-"), word), " ")


def shared_directory(left: Column, right: Column) -> Column:
    """Suggested home of code shared by two files: utils/ below their common directory."""
    a = F.split(left, "/")
    b = F.split(right, "/")
    depth = F.least(F.size(a), F.size(b)) - 1
    same = F.zip_with(F.slice(a, F.lit(1), depth), F.slice(b, F.lit(1), depth), lambda x, y: x == y)
    first_gap = F.array_position(same, False).cast("int")
    joined = F.array_join(F.slice(a, F.lit(1), F.when(first_gap == 0, depth).otherwise(first_gap - 1)), "/")
    return F.when(joined == "", F.lit("shared/utils/")).otherwise(F.concat(joined, F.lit("/utils/")))


def wikilinks_to_internal(col: Column) -> Column:
    """[[Target|label]] and [[Target]] to [label](wiki://Target)."""
    named = F.regexp_replace(col, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "[$2](wiki://$1)")
    return F.regexp_replace(named, r"\[\[([^\]|]+)\]\]", "[$1](wiki://$1)")


def internal_to_wikilinks(col: Column) -> Column:
    return F.regexp_replace(col, r"\[([^\]]+)\]\(wiki://([^)]+)\)", "[[$2|$1]]")


def wiki_link_targets(col: Column) -> Column:
    """Page ids of wiki:// links outside code spans, without fragments."""
    visible = F.regexp_replace(F.regexp_replace(col, r"(?s)```.*?```", ""), r"`[^`\n]*`", "")
    return matches(visible, r"wiki://([^)#\s\"]+)", 1)


def href_targets(col: Column) -> Column:
    return matches(col, r'href="([^"#]+)', 1)
