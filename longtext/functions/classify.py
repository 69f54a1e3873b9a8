"""Event classification by ordered rules, as CASE expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from .text import count_labels


def _first_rule(text: Column) -> Column:
    out = None
    for pattern, kind in L.EVENT_RULES:
        out = F.when(text.rlike("(?i)" + pattern), kind) if out is None else out.when(text.rlike("(?i)" + pattern), kind)
    return out


def event_type(title: Column, body: Column) -> Column:
    """First rule that the title meets; else the first that the body's first 1500 characters meet; else other."""
    return F.coalesce(_first_rule(title), _first_rule(F.substring(body, 1, 1500)), F.lit("other"))


def has_q_and_a(body: Column) -> Column:
    return F.coalesce(count_labels(body, L.QUESTION_LABEL, True) >= 2, F.lit(False))


def preparation(kind: Column, q_and_a: Column) -> Column:
    return (
        F.when(kind.isin(*L.PREPARED), "prepared")
        .when(kind.isin(*L.SPOKEN), F.when(q_and_a, "impromptu").otherwise("mixed"))
        .when(kind.isin(*L.MIXED), "mixed")
        .otherwise("unknown")
    )


def setting(title: Column, body: Column) -> Column:
    head = F.substring(F.coalesce(body, F.lit("")), 1, 1500)
    campaign = F.coalesce(title, F.lit("")).rlike("(?i)" + L.CAMPAIGN_HINTS) | head.rlike("(?i)" + L.CAMPAIGN_HINTS)
    return F.when(campaign, "campaign").when(head.rlike("(?i)" + L.OFFICIAL_HINTS), "official")


def updated(new: Column, old: Column) -> Column:
    """The new value unless it is blank."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def classify(df: DataFrame, title: str = "title", body: str = "text", only_missing: str | None = None) -> DataFrame:
    """Add event_type, has_q_and_a, prepared_or_impromptu, campaign_or_official; with only_missing, rows that have that column keep theirs."""
    t, b = F.col(title), F.col(body)
    made = df.withColumns({"_kind": event_type(t, b), "_qa": has_q_and_a(b)})
    made = made.withColumns({"_prep": preparation(F.col("_kind"), F.col("_qa")), "_set": setting(t, b)})
    names = {"event_type": "_kind", "has_q_and_a": "_qa", "prepared_or_impromptu": "_prep", "campaign_or_official": "_set"}
    for name, new in names.items():
        value = F.col(new)
        if name in df.columns and only_missing:
            value = F.when(F.coalesce(F.nullif(F.col(only_missing).cast("string"), F.lit("")), F.lit("")) == "", value).otherwise(F.col(name))
        elif name == "campaign_or_official" and name in df.columns:
            value = updated(value, F.col(name))
        made = made.withColumn(name, value)
    return made.drop(*names.values())


def repaired_json(reply: Column, schema: str) -> Column:
    """A model's reply as a struct: fences off, else the part from the first { to the last }; null if neither parses."""
    bare = F.trim(F.regexp_replace(F.trim(reply), r"^```(?:json)?|```$", ""))
    block = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull() & x.startswith("{"), F.from_json(x, schema)) for x in (bare, block)])


def validated(new: Column, allowed: tuple[str, ...], fallback: Column) -> Column:
    return F.when(new.isin(*allowed), new).otherwise(fallback)


REPLY = "event_type string, prepared_or_impromptu string, has_q_and_a string, campaign_or_official string"
PREPARATIONS = ("prepared", "impromptu", "mixed", "unknown")


def classify_by_model(df: DataFrame, ask: Callable[[str, str], str], title: str = "title", body: str = "text", most: int = 4000) -> DataFrame:
    """The same four columns from a model's JSON replies; a reply that does not parse leaves the rules' answer.

    ask(title, excerpt) returns the reply. It runs on the executors, one call per row, and may raise:
    then the rules' answer stays as well.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = []
            for t, b in zip(batch[title], batch[body], strict=True):
                try:
                    replies.append(ask(t or "", (b or "")[:most]))
                except Exception:  # the transport is the caller's: any failure counts as no reply
                    replies.append(None)
            yield batch.assign(_reply=replies)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ruled = classify(df.mapInPandas(run, f"{schema}, _reply string"), title, body)
    r = repaired_json(F.col("_reply"), REPLY)
    some = r.isNotNull()
    return ruled.withColumns(
        {
            "event_type": F.when(some, validated(r["event_type"], L.EVENT_TYPES, F.lit("other"))).otherwise(F.col("event_type")),
            "prepared_or_impromptu": F.when(some, validated(r["prepared_or_impromptu"], PREPARATIONS, F.lit("unknown"))).otherwise(F.col("prepared_or_impromptu")),
            "has_q_and_a": F.when(some, F.coalesce(F.lower(r["has_q_and_a"]).isin("true", "yes", "1"), F.lit(False))).otherwise(F.col("has_q_and_a")),
            "campaign_or_official": F.when(some, validated(F.lower(r["campaign_or_official"]), ("campaign", "official"), F.lit(None))).otherwise(F.col("campaign_or_official")),
        }
    ).drop("_reply")
