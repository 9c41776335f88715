import pytest
from pyspark.sql import functions as F

from lexiloom.functions import hashing, text as tx
from lexiloom.operators import segments as sg
from lexiloom.operators.search import pattern_matches
from lexiloom.sources import paths as pa


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()[0]


def test_word_tokens_keep_accents_and_skip_cjk(spark):
    assert one(spark, tx.word_tokens(F.lit("Foo-bar é x Été 日本語 a_b"))) == ["foo-bar", "Ét".lower().replace("é", "É") + "é", "a_b"]


def test_bigrams(spark):
    assert one(spark, tx.character_bigrams(F.lit("a b c"))) == ["ab", "bc"]
    assert one(spark, tx.character_bigrams(F.lit(" x "))) == ["x"]
    assert one(spark, tx.character_bigrams(F.lit(""))) == []
    assert one(spark, tx.similarity_tokens(F.lit("日本語"))) == ["日本", "本語"]


def test_section_references(spark):
    text = F.lit("See Section 3.1 and 4.2. Also sections 5, 6 or 7. Section nine has 8.")
    assert one(spark, tx.section_references(text)) == ["3.1", "4.2", "5", "6", "7"]
    assert one(spark, tx.section_reference_score(F.array(F.lit("3.1")), F.array(F.lit("3")))) == 0.24
    assert one(spark, tx.section_reference_score(F.array(F.lit("3")), F.array(F.lit("3")))) == 0.45


def test_literals(spark):
    assert one(spark, tx.text_literals(F.lit("port 8080, 5, `data:`"))) == ["8080", "data:"]
    assert one(spark, tx.literal_present(F.lit("mask 0xff"), F.lit("255")))
    assert one(spark, tx.normative_strength(F.lit("it must not"))) == "MUST"


def test_slugs_and_paths(spark):
    assert one(spark, tx.title_to_slug(F.lit("API: Notes (v2)/Old"))) == "api-notes-v2-old"
    assert one(spark, tx.slug_to_title(F.lit("api-notes/old"))) == "Api Notes/Old"
    assert one(spark, tx.shared_directory(F.lit("a/b/c.x"), F.lit("a/d/e.x"))) == "a/utils/"
    assert one(spark, tx.extension(F.lit("a/b.tar.gz"))) == ".gz"
    assert one(spark, tx.wiki_link_targets(F.lit("[a](wiki://x#y) `[b](wiki://z)`"))) == ["x"]


def test_fnv_known_value(spark):
    assert one(spark, hashing.fnv1a(F.lit("a"))) == 0xE40C292C & 0x7FFFFFFF
    assert one(spark, hashing.fnv1a(F.lit(""))) == 0x811C9DC5 & 0x7FFFFFFF


def test_globs_and_filters(spark):
    rows = spark.createDataFrame([("src/a.py",), ("src/x/b.py",), ("node_modules/c.py",), ("docs/d.md",)], "path string")
    hit = [r[0] for r in rows.where(pa.glob_match(F.col("path"), "src/**/*.py")).collect()]
    assert sorted(hit) == ["src/a.py", "src/x/b.py"]
    kept = rows.where(pa.should_include(F.col("path"), excludes=["docs/**"], ignore_lines=["*.py", "!a.py"]))
    assert [r[0] for r in kept.collect()] == ["src/a.py"]


def test_sentences_protect_quotes(spark):
    docs = spark.createDataFrame([(1, "彼は「はい。行く。」と言った。次。No end")], "doc_id long, text string")
    rows = sg.sentences(docs).orderBy("sent_no").collect()
    assert [r["text"] for r in rows] == ["彼は「はい。行く。」と言った。", "次。", "No end"]
    assert rows[1]["start"] == rows[0]["end"]


@pytest.mark.parametrize(
    ("ends", "blanks", "edges"),
    [
        ([50, 700, 5000, 5010, 5030], 0, [0, 700, 2700, 4700, 5030]),
        ([150, 200, 2300], 0, [0, 150, 2150, 2300]),
        ([600], 200, [0, 600]),
        ([600], 50, [0, 650]),
        ([600, 650], 0, [0, 650]),
        ([80], 0, [0, 80]),
        ([450], 20, [0, 470]),
    ],
)
def test_punctuation_chunks(spark, ends, blanks, edges):
    text = "".join("x" * (b - a - 1) + "." for a, b in zip([0, *ends], ends)) + " " * blanks
    docs = spark.createDataFrame([(1, text), (2, "  "), (3, None)], "doc_id long, text string")
    rows = sg.segment_by_punctuation(docs).orderBy("seg_no").collect()
    assert [tuple(r) for r in rows] == [(1, k + 1, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def test_pattern_search(spark):
    docs = spark.createDataFrame([(1, "take 12 apples now")], "id long, text string")
    assert [r["hit"] for r in pattern_matches(docs, "Num *").collect()] == ["Num:12 Word:apples "]
    assert [r["hit"] for r in pattern_matches(docs, "Word:take ... Word:now").collect()] == ["Word:take Num:12 Word:apples Word:now "]
    assert [r["hit"] for r in pattern_matches(docs, "Num !Num").collect()] == ["Num:12 Word:apples "]
