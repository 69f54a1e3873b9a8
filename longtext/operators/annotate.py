"""Features over annotated tokens (id, sent, i, text, lemma, pos, dep, head, person, number, is_alpha)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longtext.functions import lexicons as L

TOKEN_SCHEMA = "id string, sent int, i int, text string, lemma string, pos string, dep string, head int, person string, number string, is_alpha boolean"


def annotate(docs: DataFrame, annotator: Callable[[str], list[dict]], key: str = "id", text: str = "text", most: int = 300_000) -> DataFrame:
    """Token rows from a pluggable annotator, which gets the first `most` characters (its memory guard)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TOKEN_SCHEMA.split(", ")]
        for batch in batches:
            rows = [{"id": str(k), **t} for k, x in zip(batch[key], batch[text], strict=True) for t in annotator((x or "")[:most])]
            made = pd.DataFrame(rows, columns=names)
            yield made.astype({c: "Int32" for c in ("sent", "i", "head")} | {c: "string" for c in ("text", "lemma", "pos", "dep", "person", "number")})

    return docs.select(key, text).mapInPandas(run, TOKEN_SCHEMA)


def annotator_function(annotator: Callable[[str], list[dict]], most: int = 300_000):
    """The annotator as a table function of a text, for SQL: SELECT d.id, t.* FROM docs AS d, LATERAL annotate(d.text) AS t."""
    names = [c.split()[0] for c in TOKEN_SCHEMA.split(", ")[1:]]

    class Annotate:
        def eval(self, text: str):
            for t in annotator((text or "")[:most]):
                yield tuple(t.get(n) for n in names)

    return F.udtf(Annotate, returnType=", ".join(TOKEN_SCHEMA.split(", ")[1:]))


def tree_depth(tokens: Column, guard: int = 200) -> Column:
    """Hops from the deepest token of a sentence to its root, `guard` or the number of its tokens at most; tokens: array of (i, head).

    Heads become places in the array once. Then every step lets each token jump over what its present jump already spans, so the steps are
    the logarithm of the depth. A head outside the sentence is a root.
    """
    return _depth(F.array_sort(tokens), lambda t: t["i"], lambda t: t["head"], guard)


def packed_tree_depth(tokens: Column, guard: int = 200) -> Column:
    """tree_depth of tokens packed by packed(): the same order, eight bytes a token."""
    return _depth(F.sort_array(tokens), lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31), guard)


def packed(i: Column, head: Column) -> Column:
    """Index and head, ints that are not null, as one long that sorts as the pair does."""
    return F.shiftleft(i.cast("long"), 32).bitwiseOR(head.cast("long") + F.lit(1 << 31))


def _depth(tokens: Column, index: Callable[[Column], Column], head: Callable[[Column], Column], guard: int) -> Column:
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  # a value that lambdas use is computed once

    def parents(ordered: Column) -> Column:
        # array_position is 0 where a head is missing; nulls and the token's own index are roots
        parent = lambda ids: F.transform(ordered, lambda t, k: F.coalesce(F.nullif(F.array_position(ids, head(t)), F.lit(0)).cast("int") - 1, k))
        return bound(F.transform(ordered, index), parent)

    def deepest(to: Column) -> Column:
        most = F.least(F.lit(guard), F.size(to))
        start = F.struct(to.alias("to"), F.transform(to, lambda p, k: F.when(p == k, 0).otherwise(1)).alias("far"))

        def leap(s: Column, _: Column) -> Column:
            far = F.zip_with(s["far"], s["to"], lambda d, j: F.least(most, d + F.get(s["far"], j)))
            return F.struct(F.transform(s["to"], lambda j: F.get(s["to"], j)).alias("to"), far.alias("far"))

        steps = F.ceil(F.log2(most + 1)).cast("int")
        return F.array_max(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), steps)), start, leap, lambda s: s["far"]))

    return bound(bound(tokens, parents), deepest)


def features(tokens: DataFrame) -> DataFrame:
    """One row per document: counts, ratios and complexity of the token contract.

    Three passes over the tokens, so that little is shuffled: sums meet as one row for each document and task; lemmas as rows of two columns,
    once for each document and task, without the sums beside them; sentences, which are counted where their trees are measured, as one long a token.
    """
    alpha, pos, dep = F.col("is_alpha"), F.col("pos"), F.col("dep")
    n = F.count_if(alpha)
    share = lambda cond: F.try_divide(F.count_if(alpha & cond), n)
    first = (pos == "PRON") & (F.col("person") == "1")
    me, us = F.count_if(alpha & first & (F.col("number") == "Sing")), F.count_if(alpha & first & (F.col("number") == "Plur"))
    content = alpha & pos.isin(*L.CONTENT_POS)
    far = (dep != "punct") & (F.col("head") != F.col("i"))
    base = tokens.groupBy("id").agg(
        n.alias("n_words"),
        share(pos == "PRON").alias("pronoun_ratio"),
        share(pos.isin("NOUN", "PROPN")).alias("noun_ratio"),
        share(pos == "VERB").alias("verb_ratio"),
        share(pos == "ADJ").alias("adjective_ratio"),
        share(pos == "ADV").alias("adverb_ratio"),
        share(pos.isin(*L.FUNCTION_POS)).alias("function_word_ratio"),
        share(pos.isin(*L.PROPOSITION_POS)).alias("idea_density"),
        F.try_divide(me, n).alias("first_person_singular_ratio"),
        F.try_divide(us, n).alias("first_person_plural_ratio"),
        F.when(us > 0, me / us).otherwise(me.cast("double")).alias("i_to_we_ratio"),
        F.coalesce(F.avg(F.when(far, F.abs(F.col("i") - F.col("head")))), F.lit(0.0)).alias("mean_dependency_distance"),
        F.count_if(dep.isin(*L.SUBORDINATE_DEPS)).alias("_subordinate"),
        F.count_if(dep.isin(*L.CLAUSE_DEPS) & pos.isin("VERB", "AUX")).alias("_clauses"),
        F.count_if(content).alias("_content"),
    )
    lemmas = tokens.filter(content).select(F.col("id").alias("_id"), F.lower("lemma").alias("lemma")).dropna(subset="lemma").distinct()
    lemmas = lemmas.groupBy("_id").agg(F.count("*").alias("_lemmas"))
    pair, plain = F.struct("i", "head"), F.col("i").isNotNull() & F.col("head").isNotNull()
    pairs = F.collect_list(F.when(plain, packed(F.col("i"), F.col("head")))), F.collect_list(F.when(~plain, pair))
    trees = tokens.groupBy("id", "sent").agg(pairs[0].alias("_plain"), pairs[1].alias("_odd"))
    unpacked = F.transform("_plain", lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("i"), (x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int").alias("head")))
    depth = F.when(F.size("_odd") == 0, packed_tree_depth(F.col("_plain"))).otherwise(tree_depth(F.concat(unpacked, "_odd")))
    trees = trees.select("id", "sent", depth.alias("depth"))
    sentences = trees.groupBy("id").agg(F.count("sent").alias("n_sentences"), F.avg("depth").alias("mean_tree_depth"))
    both = base.join(lemmas, F.col("id").eqNullSafe(F.col("_id")), "left").join(sentences, "id", "left")
    rates = {
        "content_ttr": F.try_divide(F.coalesce("_lemmas", F.lit(0)), F.col("_content")),
        "subordination_ratio": F.try_divide("_subordinate", "n_sentences"),
        "clauses_per_sentence": F.try_divide("_clauses", "n_sentences"),
    }
    return both.withColumns(rates).select(*[c for c in base.columns if not c.startswith("_")], "content_ttr", "n_sentences", "mean_tree_depth", "subordination_ratio", "clauses_per_sentence")
