"""Hand-derived cases of the text functions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from longtext.functions import classify as C
from longtext.functions import diversity as D
from longtext.functions import text as X
from longtext.functions import udfs as U
from longtext.operators import segment


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(column.alias("out")).first()[0]


def test_ids_and_slugs(spark):
    assert one(spark, X.stable_id(F.lit("src0"), F.lit("http://x"), F.lit("2020-01-01"))) == "src0_fe4c9a777543da5a"
    assert one(spark, X.slug(F.lit("Émile & Co.!"))) == "emile-co"
    assert one(spark, X.slug(F.lit(""))) == "untitled"
    assert one(spark, U.nfkd_ascii(F.lit("Ǆé"))) == "DZe"


def test_neutral_codes(spark):
    code = lambda k, d: one(spark, X.neutral_code(F.lit(k), F.lit(d).cast("date")))
    assert [code("trump", "2021-01-20"), code("trump", None), code("x", None), code("reagan", None)] == ["V", "S", "?", "K"]
    assert one(spark, X.code_name(F.lit("M"))) == "G.H.W. Bush"


def test_speaker_order(spark):
    assert one(spark, X.speaker_of(F.lit("met Trump and Reagan"))) == "reagan"
    assert one(spark, X.speaker_of(F.lit("nobody"))) is None


def test_normalise(spark):
    text = "Home\n[Applause] Home\n  a   b  \n\n\n\n\nc"
    assert one(spark, X.normalized(F.lit(text))) == "[Applause] Home\na b\n\nc\n"
    assert one(spark, X.normalized(F.lit("©2020 X\n© 2020 X\n‘q’ “r” – —"))) == "© 2020 X\n'q' \"r\" - --\n"


def test_header(spark):
    head, body = X.split_header(F.col("t"))
    row = spark.createDataFrame([("# a\n\n# b\nx\n# y",), ("x",), ("# a",)], "t string").select(head.alias("h"), body.alias("b")).collect()
    assert [tuple(r) for r in row] == [("# a\n\n# b", "x\n# y"), ("", "x"), ("# a", "")]
    assert one(spark, X.without_comment_lines(F.lit("# a\nx\n# b\ny"))) == "x\ny"


def test_sentences(spark):
    assert one(spark, X.sentences(F.lit('Hi there. Bob? "No" he. x'))) == ["Hi there.", "Bob?", '"No" he. x']


@pytest.mark.parametrize(("answer", "counted"), [("THE PRESIDENT: b", 1), ("The President. b", 0)])
def test_labels(spark, answer, counted):
    from longtext.functions import lexicons as L

    text = F.lit(f"Q. a\n\n{answer}\n\nQ. c")
    q, a = X.count_labels(text, L.QUESTION_LABEL, True), X.count_labels(text, L.ANSWER_LABEL, False)
    assert (one(spark, q), one(spark, a), one(spark, X.question_answer_ratio(q, a))) == (2, counted, 2.0)
    assert one(spark, C.has_q_and_a(text)) is True


def test_classify(spark):
    rows = [("Remarks at a Campaign Rally", ""), ("The President's News Conference", "Q. a\nQ. b"), ("The President's News Conference", ""), ("Letter", "at the white house"), (None, None)]
    found = C.classify(spark.createDataFrame(rows, "title string, text string")).select("event_type", "prepared_or_impromptu", "campaign_or_official").collect()
    assert [tuple(r) for r in found] == [
        ("rally", "mixed", "campaign"), ("press_conference", "impromptu", None), ("press_conference", "mixed", None), ("other", "unknown", "official"), ("other", "unknown", None),
    ]


def test_model_reply_repair(spark):
    ask = lambda s: one(spark, C.repaired_json(F.lit(s), "event_type string"))
    assert ask('```json\n{"event_type": "rally"}\n```')["event_type"] == "rally"
    assert ask('Sure: {"event_type": "debate"} ok')["event_type"] == "debate"
    assert ask("nothing") is None


def test_segmentation(spark):
    parts = ["The President. Opening.", "Q. What?", "Tax Policy", "The President. We will [laughter] act.", "It is good.", "Mr. Smith. Thank you.", "The Vice President. I agree.", "More words here."]
    docs = spark.createDataFrame([("a", "\n\n".join(parts)), ("b", "The President. Only this.")], "id string, text string")
    found = {r.id: r.text for r in segment.answers(segment.paragraph_rows(docs)).collect()}
    assert found == {"a": "We will act. It is good. Mr. Smith. Thank you.", "b": ""}


def test_diversity(spark):
    words = [["a", "b", "a"], [], ["w"] * 49, ["w"] * 60, [f"w{i}" for i in range(60)], [f"w{i % 40}" for i in range(200)]]
    df = spark.createDataFrame([(w,) for w in words], "w array<string>").withColumns({"c": D.window_counts("w"), "m": D.mtld_counts("w")})
    rows = df.select(D.mattr(F.col("w"), F.col("c")), D.mtld(F.size("w"), F.col("m")), D.ttr(F.col("w")), "c.hapax").collect()
    assert [round(r[0], 4) for r in rows] == [0.6667, 0.0, 0.0204, 0.02, 1.0, 0.8]
    assert [round(r[1], 2) for r in rows[:5]] == [0.0, 0.0, 0.0, 2.0, 60.0]
    assert rows[0][3] == 1


def test_diversity_equals_brute_force(spark):
    draw = random.Random(1)
    words = [None, [], ["a"]] + [[f"w{draw.randint(0, most)}" for _ in range(draw.randint(1, 260))] for most in (0, 5, 40, 300) * 8]

    def factors(w, full=0, start=0):
        ends = (e for e in range(start + 1, len(w) + 1) if len(set(w[start:e])) / (e - start) <= D.THRESHOLD)
        end = next(ends, None)
        return (full, len(set(w[start:])), len(w) - start) if end is None else factors(w, full + 1, end)

    df = spark.createDataFrame([(w,) for w in words], "w array<string>")
    for r in df.select("w", D.window_counts("w").alias("c"), D.mtld_counts("w").alias("m")).collect():
        w = r.w or []
        width = min(D.WINDOW, len(w))
        windows = [w[i : i + width] for i in range(len(w) - width + 1)] if w else []
        assert tuple(r.c) == (sum(len(set(x)) for x in windows), len(windows), sum(w.count(x) == 1 for x in set(w)))
        assert tuple(r.m) == factors(w) + factors(w[::-1])


def test_similarity():
    assert round(U.indel("kitten", "sitting"), 2) == 61.54
    assert U.indel("", "") == 100.0
    assert U.token_set("remarks on trade", "trade remarks on") == 100.0
    assert U.token_set("", "x") == 0.0
    assert [U.lancaster(w) for w in ("maximum", "presumably", "provision", "owed", "ear", "saying")] == ["maxim", "presum", "provid", "ow", "ear", "say"]
    assert [U.english_stem(w) for w in ("running", "happy", "consistency", "hoping", "national")] == ["run", "happi", "consist", "hope", "nation"]


def test_p_value():
    assert round(U.correlation_p(0.8, 5), 3) == 0.104
    assert U.correlation_p(0.5, 2) != U.correlation_p(0.5, 2)


def test_sentiment():
    up, down = U.sentiment("very good", {"good": 1.9}), U.sentiment("not good", {"good": 1.9})
    assert up[0] > 0.44 and down[0] < 0
    assert U.sentiment(None, {}) == (0.0, 0.0, 0.0, 0.0)


def test_dates_and_coercion(spark):
    day = lambda s: one(spark, X.parsed_date(F.lit(s)))
    assert day("January 5, 1985") == day("1985-01-05") == datetime.date(1985, 1, 5)
    assert day("no date") is None
    assert one(spark, X.date_in_name(F.lit("rally_20200818_x"))) == datetime.date(2020, 8, 18)
    assert one(spark, X.date_in_name(F.lit("2020-8-18"))) is None
    bools = [one(spark, X.to_bool(F.lit(v))) for v in ("1", "True", "yes", "no", "maybe", "")]
    assert bools == [True, True, True, False, None, None]
    assert one(spark, X.to_number(F.lit(" "))) is None
