"""Question-and-answer transcripts: carry the speaker through the paragraphs and keep the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longtext.functions import lexicons as L
from longtext.functions.text import strip


def is_topic_header(p: Column) -> Column:
    """Nine words or fewer and no closing mark."""
    return (F.regexp_count(p, F.lit(r"(?U)\S+")) <= 9) & ~p.rlike(r"[.!?\")\:]$")


def paragraph_rows(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, pos, p): the non-blank paragraphs of each text, trimmed."""
    rows = docs.select(key, F.posexplode(F.split(F.col(text), r"\n\s*\n")).alias("pos", "p"))
    return rows.withColumn("p", strip(F.col("p"))).filter("p != ''")


def answers(paragraphs: DataFrame, key: str = "id", pos: str = "pos", p: str = "p") -> DataFrame:
    """(key, text): what the main speaker says after the first question.

    Every paragraph is a question, the start of an answer, another speaker's turn, a topic header or a
    continuation. The last speaker seen and whether a question has been asked are running windows over one
    document's paragraphs. Documents without answers give the empty text.
    """
    c = F.col(p)
    question, answer = c.rlike("(?i)" + L.TURN_QUESTION), c.rlike(L.TURN_ANSWER)
    kind = F.when(question, "question").when(answer, "answer").when(c.rlike("(?i)" + L.TURN_OTHER), "other").when(is_topic_header(c), "header").otherwise("more")
    rows = paragraphs.withColumn("_kind", kind)
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col("_kind") == "answer", True).when(F.col("_kind").isin("question", "other"), False)
    rows = rows.withColumn("_mine", F.last(state, ignorenulls=True).over(before)).withColumn("_asked", F.max(F.col("_kind") == "question").over(before))
    said = F.when(F.col("_kind") == "answer", F.regexp_replace(c, L.TURN_ANSWER, "")).when(F.col("_kind") == "more", c)
    kept = F.when(F.col("_mine") & F.col("_asked"), said)
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(kept.isNotNull(), F.struct(F.col(pos).alias("i"), kept.alias("t"))))).alias("_parts"))
    whole = F.array_join(F.transform("_parts", lambda x: x["t"]), " ")
    return parts.select(key, strip(F.regexp_replace(F.regexp_replace(whole, r"\[[^\]]*\]", " "), r"(?U)\s+", " ")).alias("text"))
