"""Features of tokens: what is shuffled, and packed trees against plain ones."""

import random
import re

from pyspark.sql import functions as F

from longtext.operators import annotate


def rows():
    rng, found = random.Random(5), []
    ends = [None, -(10**9), -1, 0, 10**9]
    for d in [None, *"abcdef"]:
        for sent in range(4):
            for i in range(rng.randint(1, 9)):
                # indexes repeat and are missing now and then; heads point anywhere
                at = rng.choice([i, i, i, 1, None, -2])
                head = rng.choice([i, i - 1, i + 1, rng.randint(-3, 9), rng.choice(ends)])
                lemma = rng.choice(["See", "see", "go", None])
                found.append((d, sent, at, "w", lemma, rng.choice(["NOUN", "VERB", "DET"]), "dep", head, "1", "Sing", rng.random() < 0.9))
    return found


def test_packed_trees_lemmas_and_null_ids(spark):
    made = rows()
    tokens = spark.createDataFrame(made, annotate.TOKEN_SCHEMA)
    plain = tokens.groupBy("id", "sent").agg(annotate.tree_depth(F.collect_list(F.struct("i", "head"))).alias("d")).groupBy("id").agg(F.avg("d").alias("d"))
    want = {r.id: r.d for r in plain.collect() if r.id}
    got = {r.id: r for r in annotate.features(tokens).collect()}
    assert {k: r.mean_tree_depth for k, r in got.items() if k} == want
    for k, r in got.items():
        content = [x[4] for x in made if x[0] == k and x[10] and x[5] in ("NOUN", "VERB")]
        assert r.content_ttr == len({x.lower() for x in content if x}) / len(content)


def test_packed_trees_of_plain_tokens(spark):
    sets = [[(x[2], x[7]) for x in rows()[n : n + 7] if x[2] is not None and x[7] is not None] for n in range(0, 60, 7)]
    df = spark.createDataFrame([(s,) for s in sets if s], "t array<struct<i:int,head:int>>")
    packed = F.transform("t", lambda t: annotate.packed(t["i"], t["head"]))
    assert all(r.a == r.b for r in df.select(annotate.tree_depth(F.col("t")).alias("a"), annotate.packed_tree_depth(packed).alias("b")).collect())


def test_no_sums_travel_beside_lemmas_and_no_structs_beside_packed_tokens(spark):
    plan = annotate.features(spark.createDataFrame(rows(), annotate.TOKEN_SCHEMA))._jdf.queryExecution().executedPlan().toString()
    by_lemma = [x for x in plan.splitlines() if re.search(r"Aggregate\(keys=\[[^]]*lemma", x)]
    assert by_lemma and all("functions=[]" in x for x in by_lemma)
