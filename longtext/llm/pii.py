"""Information-theoretic sanitisation of personal data, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, match_spans, returned, small_enough, stage_table, table
from .secrets import joined_spans

# The base patterns. Possessive forms and lookbehinds match what the plain forms match, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

TERM = r"[\p{L}\p{N}]{3,}"
#: Code points on either side of a protected value that, with the value, tell contexts apart.
CONTEXT = 80
#: Different contexts in which an entity must meet a term before their estimate counts.
SUPPORT = 2
#: Contexts are counted up to this number, as bits of a mask: two that share a bit count as one.
MASK = 62
#: Share of an entity's information that a term may disclose: from the first on it is generalised, from the second on removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Texts in which a term is taken to stand without the entity besides those seen, for a pair seen in one context.
DOUBT = 1
#: Revealing terms up to so many are broadcast; beyond, the documents of a term are dealt over SALTS groups.
MOST_SENT, SALTS = 200_000, 16

SPAN = "array<struct<s:int,e:int,m:string>>"


def luhn(digits: Column) -> Column:
    doubled = lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("."), F.lit(0)), doubled)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def byte_part(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(short) > 3, False).otherwise(F.concat(F.lit("0"), short).cast("int") <= 255)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


#: The value that a span names, and the group it belongs to: the mail domain, the network, the issuer, the exchange.
VALUE = {"email": lambda m: F.lower(m), "ip": lambda m: m, "card": digits_of, "phone": digits_of}
GROUP = {
    "email": lambda v: F.regexp_replace(v, "^[^@]*@", "@"),
    "ip": lambda v: F.regexp_replace(v, "[0-9]+$", "*"),
    "card": lambda v: F.concat(F.substring(v, 1, 6), F.lit("*")),
    "phone": lambda v: F.regexp_replace(v, "....$", "*"),
}


def base_spans(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Add arrays email, ip, card, phone of structs (s, e, m)."""
    found = match_spans(docs, text, {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE})
    return found.withColumns(
        {
            "ip": F.filter("ip", lambda x: F.forall(F.split(x["m"], r"\."), byte_part)),
            "card": F.filter("card", lambda x: F.when(F.length(digits_of(x["m"])).between(13, 19), luhn(digits_of(x["m"]))).otherwise(False)),
            "phone": F.filter("phone", lambda x: F.length(digits_of(x["m"])).between(9, 15)),
        }
    )


def with_values(docs: DataFrame, text: str) -> DataFrame:
    """Stored rows of docs: _in (the caller's columns), _row, arrays email, ip, card, phone, and _text, the text or ''."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = base_spans(carried(docs, _text=whole)).drop("_text").withColumn("_row", F.monotonically_increasing_id())
    stored = stage_table(found, "pii-rows")
    return stored.withColumn("_text", F.coalesce(F.col("_in")[text].cast("string"), F.lit("")))


def holds_values() -> Column:
    return F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0


def entities_of(text: Column) -> Column:
    """Structs (name, bits) of each value of a row: the value, its group and its kind, each with the bit of the value's context."""

    def each(kind: str) -> Column:
        def named(x: Column) -> Column:
            at = F.greatest(x["s"] - CONTEXT, F.lit(0))
            value = VALUE[kind](x["m"])
            context = F.md5(F.concat_ws("\x01", F.substring(text, at + 1, x["s"] - at), value, F.substring(text, x["e"] + 1, F.lit(CONTEXT))))
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.conv(F.substring(context, 1, 2), 16, 10).cast("int") % MASK)
            names = F.array(F.concat(F.lit(f"{kind}="), value), F.concat(F.lit(f"{kind}~"), GROUP[kind](value)), F.lit(kind))
            return F.transform(names, lambda n: F.struct(n.alias("name"), bit.alias("bits")))

        return F.flatten(F.transform(kind, named))

    return F.concat(*[each(k) for k in KINDS])


def redacted(text: Column, spans: Column) -> Column:
    """Text with sorted spans (s, e, tag) replaced; what overlaps an earlier span lengthens it."""
    out = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("a")),
        lambda s, x: F.when(
            x["s"] >= s["at"],
            F.struct(x["e"].alias("at"), F.concat(s["a"], F.array(F.substring(text, s["at"] + 1, x["s"] - s["at"]), x["tag"])).alias("a")),
        ).otherwise(F.struct(F.greatest(s["at"], x["e"]).alias("at"), s["a"].alias("a"))),
        lambda s: F.concat(F.array_join(s["a"], ""), F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, out).otherwise(text)


def tagged(kind: str, tag) -> Column:
    return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), tag(x["m"]).alias("tag")))


def terms_of() -> Column:
    """The different terms of a row's text without its values, in lower case."""
    bare = redacted(F.col("_text"), F.array_sort(F.concat(*[tagged(k, lambda m: F.lit(" ")) for k in KINDS])))
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))


def revealing_terms(rows: DataFrame) -> DataFrame:
    """(term, r): the terms of rows (see with_values) that give some protected entity away; r says whether the term goes altogether.

    Entities are the protected values, the groups they belong to and their kinds, so that what always stands
    with new addresses of one kind is found as well as what stands with one address. Of n documents, n_t hold
    a term, n_v an entity and n_tv both, anywhere in the text; u is the number of different contexts in which
    the entity stands in those. A term discloses PMI / IC = 1 + log(P) / log(n / n_v) of the entity's
    information, where P = n_tv / (n_t + DOUBT n_tv / u) is the smoothed share of the term's documents that
    hold the entity. A pair needs SUPPORT contexts, so that copies of one passage prove nothing.

    All documents count. Contexts are masks of bits and everything is combined per task before a shuffle, so
    no entity or term, however frequent, gathers its rows in one task. Only entities with SUPPORT contexts are
    paired with terms, and only the terms of such pairs are counted over the corpus.
    """
    held = rows.filter(holds_values()).select("_row", entities_of(F.col("_text")).alias("x"), terms_of().alias("t"))
    held = stage_table(held, "pii-held")
    entities = held.select("_row", F.explode("x").alias("x")).groupBy("_row", "x.name").agg(F.expr("bit_or(x.bits)").alias("bits"))
    entities = stage_table(entities, "pii-entities")
    values = entities.groupBy("name").agg(F.count("*").alias("n_v"), F.expr("bit_count(bit_or(bits))").alias("u")).filter(F.col("u") >= SUPPORT)
    values = stage_table(values.select("name", "n_v"), "pii-values")
    several = F.broadcast(values) if small_enough(values, MOST_SENT) else values
    met = entities.join(several, "name").join(held.select("_row", "t"), "_row").select("name", "n_v", "bits", F.explode("t").alias("term"))
    pairs = met.groupBy("name", "n_v", "term").agg(F.count("*").alias("n_tv"), F.expr("bit_count(bit_or(bits))").alias("u")).filter(F.col("u") >= SUPPORT)
    pairs = stage_table(pairs, "pii-pairs")
    wanted = stage_table(pairs.select("term").distinct(), "pii-terms")
    heard = rows.select(F.explode(terms_of()).alias("term"))
    if small_enough(wanted, MOST_SENT):
        heard = heard.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        heard = heard.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term")
    known = pairs.join(heard, "term").crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).filter("n > n_v")
    seen = F.col("n_tv") / (F.col("n_t") + DOUBT * F.col("n_tv") / F.col("u"))
    disclosure = 1 + F.log(seen) / F.log(F.col("n") / F.col("n_v"))
    told = known.groupBy("term").agg(F.max(disclosure).alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)
    return stage_table(told.select("term", (F.col("disclosure") >= REMOVE).alias("r")), "pii-reveals")


def among(terms: DataFrame) -> Callable[[Column], Column]:
    """A test whether a term is one of these (column term): they are sent to all tasks as a constant, strings of terms by a hash, so no row moves."""
    many = 1 << max(0, terms.count() - 1).bit_length()
    at = lambda t: F.pmod(F.xxhash64(t), F.lit(many)).cast("int")
    parts = [","] * many
    for x in terms.select(at(F.col("term")).alias("at"), "term").toLocalIterator():
        parts[x.at] += x.term + ","  # letters and digits
    table = F.split(F.lit(";".join(parts)), ";")
    return lambda t: F.contains(F.get(table, at(t)), F.concat(F.lit(","), t, F.lit(",")))


def marked(rows: DataFrame, reveals: DataFrame) -> DataFrame:
    """rows with gone and general, the forms in which revealing terms stand in each.

    Up to MOST_SENT terms every row is looked through where it lies. Beyond, the hits are joined to the rows, and both are shuffled.
    """
    if not small_enough(reveals, MOST_SENT):
        hits = terms_by_row(rows, reveals)
        return rows.join(F.broadcast(hits) if small_enough(hits, 50_000) else hits, "_row", "left")
    any_of, gone = among(reveals), among(reveals.filter("r"))
    forms = F.array_distinct(F.regexp_extract_all(F.col("_text"), F.lit(TERM), F.lit(0)))
    found = rows.withColumn("_forms", F.filter(forms, lambda f: any_of(F.lower(f))))
    found = found.withColumns({"gone": F.filter("_forms", lambda f: gone(F.lower(f))), "general": F.filter("_forms", lambda f: ~gone(F.lower(f)))})
    return found.drop("_forms")


def terms_by_row(rows: DataFrame, reveals: DataFrame) -> DataFrame:
    """(_row, gone, general): the forms in which revealing terms stand in each row that holds any. A common term's rows are dealt over SALTS."""
    forms = F.array_distinct(F.regexp_extract_all(F.col("_text"), F.lit(TERM), F.lit(0)))
    heard = rows.select("_row", F.explode(forms).alias("form")).withColumn("term", F.lower("form"))
    if small_enough(reveals, MOST_SENT):
        hits = heard.join(F.broadcast(reveals), "term")
    else:
        dealt = reveals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        hits = heard.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS))).join(dealt, ["term", "_salt"])
    sets = [F.collect_list(F.when(c, F.col("form"))).alias(name) for name, c in (("gone", F.col("r")), ("general", ~F.col("r")))]
    return stage_table(hits.groupBy("_row").agg(*sets), "pii-hits")


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of docs with all spans: _in (the caller's columns), _text, and arrays email, ip, card, phone, generalise, remove of (s, e, m).

    The last two are the places of revealing terms (see revealing_terms), in whatever document they stand, where
    they touch no value. A row's terms (see marked) are sought in that row's text alone, by a pattern made of them.

    Null and empty texts have no spans. Rows are told apart by _row, not by their id: repeated and null ids are
    kept apart, and columns of any name are carried in _in. An empty table gives no rows. Work grows
    linearly with a text's length, but for a text's terms times its own values.
    """
    rows = with_values(docs, text)
    both = marked(rows, revealing_terms(rows))
    of = {}
    for name, forms in (("generalise", "general"), ("remove", "gone")):  # forms are letters and digits: nothing to escape
        of[name] = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        both = both.withColumn(f"_{name}", F.when(F.size(forms) > 0, F.col("_text")))
    for name, pattern in of.items():
        both = match_spans(both, f"_{name}", {name: pattern})
    values = F.concat(*KINDS)
    free = lambda name: F.filter(name, lambda t: ~F.exists(values, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return both.withColumns({name: free(name) for name in of}).drop("gone", "general", *[f"_{name}" for name in of])


def class_of(term: Column) -> Column:
    """What a generalised term becomes: the class of strings it belongs to."""
    return F.when(term.rlike(r"^\p{N}+$"), "[NUMBER]").when(term.rlike(r"\p{N}"), "[CODE]").otherwise("[WORD]")


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data and revealing terms taken out of the text; columns and rows unchanged.

    Values become [EMAIL], [IP], [CARD], [PHONE]; a revealing term becomes its class, [WORD], [NUMBER] or [CODE],
    or, from REMOVE on, goes, at all its places in every document. A null text stays null; texts without
    spans stay as they are. Repeated rows and ids, empty tables and clashing names: see detect().
    """
    values = [tagged(k, lambda m, k=k: F.lit(f"[{k.upper()}]")) for k in KINDS]
    spans = F.array_sort(F.concat(*values, tagged("generalise", class_of), tagged("remove", lambda m: F.lit(""))))
    rows = detect(docs, text).withColumn("_spans", spans)
    out = F.when(F.col("_in")[text].isNotNull(), redacted(F.col("_text"), F.col("_spans")))
    return rows.select(*returned(docs.columns, **{text: out.cast(docs.schema[text].dataType)}))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digests of base spans, all spans, and counts of revealing terms. Edge cases: see detect()."""
    rows = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [(i, k, k) for i, k in enumerate(KINDS)]
    return rows.select(
        F.col("_in.doc_id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined_spans(base, False), 256).alias("base_sha256"),
        joined_spans([*base, (4, "generalise", "generalise"), (5, "remove", "remove")], False).alias("spans"),
        F.size("generalise").cast("long").alias("n_generalised"),
        F.size("remove").cast("long").alias("n_removed"),
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT r, 0 AS k, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS m,
         string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS g FROM d
  UNION ALL SELECT r, 1, 'ip', regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
         string_split_regex(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM d
  UNION ALL SELECT r, 2, 'card', regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(t, '[0-9](?:[\x20-]?[0-9])+') FROM d
  UNION ALL SELECT r, 3, 'phone', regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
  UNION ALL SELECT r, 9, 'term', regexp_extract_all(t, '[\p{L}\p{N}]{3,}'), string_split_regex(t, '[\p{L}\p{N}]{3,}') FROM d),
x AS (SELECT r, k, kind, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM f WHERE len(m) > 0),
y AS (SELECT r, k, kind, m, regexp_replace(m, '[^0-9]', '', 'g') AS dg,
             (sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i) - length(m))::BIGINT AS s,
             (sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i))::BIGINT AS e FROM x),
b AS (SELECT *, CASE k WHEN 0 THEN lower(m) WHEN 1 THEN m ELSE dg END AS v FROM y WHERE
   k = 0 OR k = 1 AND len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS INT), 999) > 255)) = 0
   OR k = 2 AND length(dg) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda j:
        CASE WHEN (length(dg) - j) % 2 = 1 THEN CASE WHEN substr(dg, j, 1)::INT > 4 THEN substr(dg, j, 1)::INT * 2 - 9 ELSE substr(dg, j, 1)::INT * 2 END
             ELSE substr(dg, j, 1)::INT END)) % 10 = 0
   OR k = 3 AND length(dg) BETWEEN 9 AND 15),
w AS (SELECT r, s, e, lower(m) AS term FROM y WHERE k = 9 AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = y.r AND b.s < y.e AND y.s < b.e)),
z AS (SELECT r, s, e, coalesce(max(e) OVER (PARTITION BY r ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM b),
bt AS (SELECT r, string_agg(CASE WHEN s > p THEN substr(t, p + 1, s - p) ELSE '' END, ' ' ORDER BY s, e) || ' ' || substr(any_value(t), max(e) + 1) AS bare
       FROM z JOIN d USING (r) GROUP BY r),
c AS (SELECT b.r, kind, v, CASE k WHEN 0 THEN regexp_replace(v, '^[^@]*@', '@') WHEN 1 THEN regexp_replace(v, '[0-9]+$', '*')
             WHEN 2 THEN substr(v, 1, 6) || '*' ELSE regexp_replace(v, '....$', '*') END AS gr,
             md5(substr(t, greatest(s - 80, 0) + 1, s - greatest(s - 80, 0)) || chr(1) || v || chr(1) || substr(t, e + 1, 80)) AS h FROM b JOIN d ON b.r = d.r),
q AS (SELECT r, unnest([kind || '=' || v, kind || '~' || gr, kind]) AS entity,
             1::BIGINT << (((strpos('0123456789abcdef', substr(h, 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2, 1)) - 1) % 62)::INT AS bits FROM c),
en AS (SELECT r, entity, bit_or(bits) AS bits FROM q GROUP BY ALL),
ev AS (SELECT entity, count(*) AS n_v FROM en GROUP BY entity HAVING bit_count(bit_or(bits)) >= 2),
dt AS (SELECT DISTINCT r, lower(unnest(regexp_extract_all(coalesce(bare, d.t), '[\p{L}\p{N}]{3,}'))) AS term FROM d LEFT JOIN bt USING (r)),
pr AS (SELECT entity, n_v, term, count(*) AS n_tv, bit_count(bit_or(bits)) AS u FROM en JOIN ev USING (entity) JOIN dt USING (r) GROUP BY ALL HAVING bit_count(bit_or(bits)) >= 2),
tt AS (SELECT term, count(*) AS n_t FROM dt GROUP BY term),
rv AS (SELECT term, max(1 + ln(n_tv / (n_t + 1 * n_tv / u)) / ln(n / n_v)) AS x FROM pr JOIN tt USING (term), (SELECT count(*) AS n FROM d) WHERE n > n_v GROUP BY term),
al AS (SELECT r, k, kind, s, e FROM b
       UNION ALL SELECT r, CASE WHEN x >= 0.95 THEN 5 ELSE 4 END, CASE WHEN x >= 0.95 THEN 'remove' ELSE 'generalise' END, s, e FROM w JOIN rv USING (term) WHERE x >= 0.8),
o AS (SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
             count(*) FILTER (k = 4) AS n_generalised, count(*) FILTER (k = 5) AS n_removed,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM al GROUP BY r)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_generalised, 0) AS n_generalised, coalesce(n_removed, 0) AS n_removed
FROM d LEFT JOIN o USING (r)
"""
