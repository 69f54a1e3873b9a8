"""The corpus pipeline as one DAG keyed by id, with the command line over it.

python -m longtext.plans.pipeline COMMAND ...

run        --input DIR --output DIR [--limit N] [--only-missing] [--features] [--no-fuzzy] [--title-threshold 90] [--text-threshold 0.85]
ingest     --folder DIR --source NAME --output DIR
stream     --folder DIR --output DIR --checkpoint DIR
normalize, dedupe, classify [--only-missing], metrics [--only-missing], features [--only-missing]: --input DIR --output DIR, one stage of run each
load       --input DIR [--features-input DIR] --output DIR: keyed merges into the serving tables
factors    --input DIR --output DIR [--columns C ...] [--factors 4] [--within speaker]
figures    --input DIR --output DIR [--max-words 1400]
report     --input DIR
replicate  --input DIR [--max-words 1400]

All but ingest and stream take --speakers NAME ..., --sources NAME ... and --limit N.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longtext.functions import classify as C
from longtext.functions import diversity as D
from longtext.functions import lexicons as L
from longtext.functions import text as X
from longtext.operators import dedupe, figures, report, segment, stats, titles, words
from longtext.plans.queries import save
from longtext.schema import published
from longtext.sources import serving, versions

EXTRACTOR_VERSION = "1.0"


def normalise(docs: DataFrame) -> DataFrame:
    _, body = X.split_header(F.col("text"))
    rows = docs.withColumn("text", X.normalized(body))
    return rows.withColumns({"ws_word_count": F.regexp_count("text", F.lit(r"(?U)\S+")), "char_count": F.length("text")})


def measure(docs: DataFrame) -> DataFrame:
    """Descriptive metrics as columns, unrounded; readability uses the vowel-group heuristic."""
    c = F.col("text")
    rows = docs.withColumns({"_w": X.alpha_words(c), "_s": X.sentences(c)})
    rows = rows.withColumn("_n", F.filter(F.transform("_s", lambda s: F.regexp_count(s, F.lit(X.ALPHA_WORD))), lambda n: n > 0))
    n, s, y = F.size("_w"), F.size("_s"), X.syllables(F.col("_w"))
    q, a = X.count_labels(c, L.QUESTION_LABEL, True), X.count_labels(c, L.ANSWER_LABEL, False)
    return rows.withColumns(
        {
            "word_count": n,
            "sentence_count": s,
            "mean_sentence_length": X.mean_of(F.col("_n")),
            "median_sentence_length": X.median_of(F.col("_n")),
            "paragraph_count": F.size(X.paragraphs(c)),
            "type_token_ratio": D.ttr(F.transform("_w", lambda w: F.lower(w))),
            "flesch_reading_ease": X.reading_ease(n, s, y),
            "flesch_kincaid_grade": X.grade_level(n, s, y),
            "speaker_label_count": X.count_labels(c, L.SPEAKER_LABEL, False),
            "question_count": q,
            "question_answer_ratio": X.question_answer_ratio(q, a),
        }
    ).drop("_w", "_s", "_n")


def lexical_features(docs: DataFrame) -> DataFrame:
    """Features that need no annotator: diversity and lexicon rates, with their provenance."""
    w = docs.select("id", "text", X.lower_words(F.col("text")).alias("w"))
    w = w.withColumns({"c": D.window_counts("w"), "m": D.mtld_counts("w")})
    n, c = F.size("w"), F.col("w")
    rate = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    return w.select(
        "id",
        F.lit("none").alias("spacy_model"),
        F.lit(EXTRACTOR_VERSION).alias("extractor_version"),
        n.alias("n_words"),
        D.ttr(c).alias("type_token_ratio"),
        D.mattr(c, F.col("c")).alias("mattr_50"),
        D.mtld(n, F.col("m")).alias("mtld"),
        rate(F.col("c.hapax")).alias("hapax_ratio"),
        rate(X.count_in(c, L.INDEFINITE_WORDS)).alias("indefinite_noun_ratio"),
        rate(X.count_in(c, L.HEDGE_WORDS) + X.hedge_phrases(F.col("text"))).alias("hedge_ratio"),
        rate(X.count_in(c, L.FILLER_WORDS)).alias("filler_ratio"),
    )


def run(docs: DataFrame, title_threshold: float = 90, text_threshold: float = 0.85, only_missing: bool = False, fuzzy: bool = True) -> DataFrame:
    """Transcripts (id, speaker, date, title, source_url, quality_score, text, ...) through all stages."""
    rows = save(normalise(docs), "normalised")
    keyed = rows.withColumn("word_count", F.col("ws_word_count"))
    found = clustered(keyed, title_threshold, text_threshold, fuzzy).withColumnRenamed("cluster_id", "duplicate_cluster_id")
    return measure(C.classify(rows.join(found, "id"), only_missing="event_type" if only_missing else None))


STUDY_SERIES = ("unique_words", "ns_plus_fillers", "li_verbs")


def study_rows(docs: DataFrame, max_words: int = L.STUDY_WORDS) -> DataFrame:
    """The study's counts of every news conference whose answers have enough words, with their place in the speaker's series."""
    talks = docs.filter(F.col("title").ilike("%news conference%"))
    said = segment.answers(segment.paragraph_rows(talks)).withColumn("w", X.lower_words(F.col("text"))).filter(F.size("w") >= max_words)
    said = save(said.select("id", F.slice("w", 1, max_words).alias("w")), "conference-words")
    counts = said.select("id", *[c.cast("double").alias(n) for n, c in X.study_features(F.col("w"), max_words).items()])
    stems = words.unique_stems(said).withColumn("unique_words", F.col("unique_words").cast("double"))
    rows = counts.join(stems, "id").join(talks.select("id", "speaker", "date"), "id")
    return save(stats.chronological(rows, "speaker", "date", "id", save=save), "conferences")


def replicate(docs: DataFrame, max_words: int = L.STUDY_WORDS) -> DataFrame:
    """Trends of the study's three counts over each speaker's news conferences, beside the published ones."""
    rows, out = study_rows(docs, max_words), None
    for feature in STUDY_SERIES:
        t = stats.against_published(stats.trend(rows, "speaker", "idx", feature), published(docs.sparkSession), "speaker", feature).withColumn("feature", F.lit(feature))
        out = t if out is None else out.unionByName(t)
    return out


def figure_tables(docs: DataFrame, max_words: int = L.STUDY_WORDS) -> dict[str, DataFrame]:
    """points, ends and overlay of every series of the study: what the cohort's figures show, by speaker and feature."""
    rows, out = study_rows(docs, max_words), {}
    for feature in STUDY_SERIES:
        kept = save(stats.trimmed(rows.select("speaker", "idx", feature), "speaker", feature), "figure-rows")
        lines = figures.trend_lines(kept, "speaker", "idx", feature)
        made = {"points": figures.cohort_points(kept, lines, "speaker", "idx", feature), "ends": figures.trend_ends(lines, "speaker"), "overlay": figures.overlay_ends(kept, "speaker", "idx", feature)}
        for name, df in made.items():
            df = df.withColumn("feature", F.lit(feature))
            out[name] = out[name].unionByName(df) if name in out else df
    return out


def missing(docs: DataFrame, found: DataFrame | None) -> DataFrame:
    """Documents whose id is not in found."""
    return docs if found is None else docs.join(found.select("id").distinct(), "id", "left_anti")


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    fs, where = versions._files(spark, path)
    return spark.read.parquet(path) if fs.exists(where) else None


def clustered(docs: DataFrame, title_threshold: float, text_threshold: float, fuzzy: bool = True) -> DataFrame:
    """(id, cluster_id, is_canonical) of documents by url, text, title and likeness."""
    edges = dedupe.url_edges(docs).unionByName(dedupe.hash_edges(docs))
    if fuzzy:
        edges = edges.unionByName(titles.title_edges(docs, save, least=title_threshold)).unionByName(dedupe.text_edges(docs, save, least=100 * text_threshold))
    return dedupe.clusters(docs, save(edges, "edges"), save)


def command(spark: SparkSession, a: argparse.Namespace) -> None:
    """One command of the line below: reads a.input (or a.folder), writes under a.output."""
    if a.command == "ingest":
        from longtext.sources.store import append
        from longtext.sources.tables import drop_folder

        print(append(drop_folder(spark, a.folder, a.source), a.output))
        return
    if a.command == "stream":
        from longtext.streaming.ingest import ingest

        print(ingest(spark, a.folder, spark.read.parquet(a.folder).schema, a.output, a.checkpoint))
        return
    docs = spark.read.parquet(a.input)
    for column, wanted in (("speaker", a.speakers), ("source", a.sources)):
        if wanted:
            docs = docs.filter(F.col(column).isin(*wanted))
    if a.limit is not None:
        docs = docs.orderBy("id").limit(a.limit)
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{a.output}/{name}")
    if a.command == "run":
        write(run(docs, a.title_threshold, a.text_threshold, a.only_missing, not a.no_fuzzy), "transcripts")
        if a.features:
            add_features(docs, f"{a.output}/features", a.only_missing)
    elif a.command == "normalize":
        write(normalise(docs), "normalized")
    elif a.command == "dedupe":
        keyed = docs if "word_count" in docs.columns else docs.withColumn("word_count", F.regexp_count("text", F.lit(r"(?U)\S+")))
        write(clustered(keyed, a.title_threshold, a.text_threshold, not a.no_fuzzy), "clusters")
    elif a.command == "classify":
        write(C.classify(docs, only_missing="event_type" if a.only_missing else None), "classified")
    elif a.command == "metrics":
        write(measure(docs.filter("word_count is null") if a.only_missing and "word_count" in docs.columns else docs), "metrics")
    elif a.command == "features":
        add_features(docs, f"{a.output}/features", a.only_missing)
    elif a.command == "load":
        found = spark.read.parquet(a.features_input) if a.features_input else None
        print(serving.load(spark, a.output, docs, found))
    elif a.command == "factors":
        columns = a.columns or [c for c, kind in docs.dtypes if kind in ("double", "float")]
        scores, load = stats.factor_scores(docs, columns, a.factors, a.within)
        write(scores, "scores")
        for i, top in enumerate(stats.top_loadings(load, columns)):
            print(f"factor {i + 1}: " + ", ".join(f"{c} {v:+.2f}" for c, v in top))
    elif a.command == "figures":
        for name, df in figure_tables(docs, a.max_words).items():
            write(df, name)
    elif a.command == "report":
        counted = [c for c in ("speaker", "source", "event_type", "year") if c in docs.columns]
        print(report.corpus_report(docs, counted, [c for c in ("quality_score", "type_token_ratio", "mean_sentence_length") if c in docs.columns]))
    else:
        replicate(docs, a.max_words).show(truncate=False)


def add_features(docs: DataFrame, path: str, only_missing: bool) -> None:
    """Lexical features of docs under path; with only_missing, of those that it does not have yet, beside the others."""
    found = _there(docs.sparkSession, path) if only_missing else None
    lexical_features(missing(docs, found)).write.mode("append" if only_missing else "overwrite").parquet(path)


COMMANDS = ("run", "ingest", "stream", "normalize", "dedupe", "classify", "metrics", "features", "load", "factors", "figures", "report", "replicate")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="longtext")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        s = sub.add_parser(name)
        for option in ("--input", "--folder", "--output", "--checkpoint", "--features-input", "--within"):
            s.add_argument(option)
        s.add_argument("--source", default="dropfolder")
        for option in ("--speakers", "--sources", "--columns"):
            s.add_argument(option, nargs="*")
        s.add_argument("--limit", type=int)
        for option in ("--only-missing", "--features", "--no-fuzzy"):
            s.add_argument(option, action="store_true")
        s.add_argument("--factors", type=int, default=4)
        s.add_argument("--max-words", type=int, default=L.STUDY_WORDS)
        s.add_argument("--title-threshold", type=float, default=90)
        s.add_argument("--text-threshold", type=float, default=0.85)
    command(SparkSession.builder.appName("longtext").getOrCreate(), p.parse_args(argv))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
