"""Secret scans: fixed patterns plus sliding-window entropy over candidate strings, in SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, match_spans, table

# The base patterns. Possessive forms and lower bounds below match what the plain forms match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings, the window, and the least entropy in bits for each character class.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
LEAST_BITS = {"hex": 3.1, "mixed": 3.85, "letters": 3.85, "digits": 2.9}
#: The classes, in the order in which they are tried; what fits none is mixed.
CLASSES = {"digits": r"^[0-9]+$", "hex": r"^[0-9a-fA-F]*[0-9][0-9a-fA-F]*$", "letters": r"^[^0-9]+$"}
#: Strings that look random but are known to be harmless.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|(?i:example|sample|placeholder|changeme|dummy|redacted)"
    r"|0123456789|(?i:abcdefghij)"
    r"|^[0-9]{4}-[0-9]{2}-[0-9]{2}[A-Za-z0-9-]*$"
)
SCALE = 1_000_000
#: round(c * log2(c) * SCALE) for counts 0..WINDOW: whole numbers keep the sums exact in any order.
SHARES = [0] + [round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1)]
FIRST, LAST = ord("+"), ord("z")


def most_sum(bits: float) -> int:
    """Largest sum of c*log2(c) over a window whose entropy is still `bits` or more."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def least_window_sum(text: Column) -> Column:
    """Least sum of c*log2(c) over all windows of a string: the entropy's maximum, found by incremental counts.

    One character enters and one leaves per step; the sum changes by four table entries.
    """
    share = F.array(*[F.lit(x).cast("long") for x in SHARES])
    codes = F.transform(F.regexp_extract_all(text, F.lit("."), F.lit(0)), lambda c: F.ascii(c) - FIRST)
    n = LAST - FIRST + 1

    def walk(code: Column, table: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            new, old = code[i], F.when(i >= WINDOW, code[i - WINDOW]).otherwise(F.lit(-1))
            a, b = s["n"][new], F.when(old >= 0, s["n"][F.greatest(old, F.lit(0))]).otherwise(F.lit(0))
            moved = s["s"] - table[a] + table[a + 1] - F.when(old >= 0, table[b] - table[F.greatest(b - 1, F.lit(0))]).otherwise(F.lit(0))
            total = F.when(new == old, s["s"]).otherwise(moved)
            counts = F.transform(s["n"], lambda x, j: x + F.when(j == new, 1).otherwise(0) - F.when(j == old, 1).otherwise(0))
            return F.struct(
                counts.alias("n"),
                total.alias("s"),
                F.when(i >= WINDOW - 1, F.least(s["b"], total)).otherwise(s["b"]).alias("b"),
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.size(code) - 1),
            F.struct(F.array_repeat(F.lit(0), n).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(2**62).cast("long").alias("b")),
            step,
            lambda s: s["b"],
        )

    return F.transform(F.array(F.struct(codes.alias("c"), share.alias("t"))), lambda x: walk(x["c"], x["t"]))[0]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of docs as _in (the caller's columns) with arrays assign, access, hex, entropy of structs (s, e, m).

    Entropy spans are candidate strings whose best window reaches the entropy of their class (digits, hex with
    a digit, letters, mixed), that no allow-list entry fits and that touch no base span. Null and empty
    texts have no spans; an empty table gives no rows. All work is per row, so hot sources and repeated rows
    need nothing special, and it grows linearly with a text's length. Columns of any name are carried in _in.
    """
    found = carried(docs, _text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    found = match_spans(found, "_text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "_cand": CANDIDATE})
    value = lambda m: F.length(m) - F.length(F.regexp_extract(m, ASSIGN_HEAD, 0))
    found = found.withColumn("assign", F.filter("assign", lambda x: value(x["m"]) >= 6))
    touches = lambda kind, c: F.exists(kind, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    free = F.filter("_cand", lambda c: ~c["m"].rlike(ALLOWED) & ~(touches("assign", c) | touches("access", c) | touches("hex", c)))
    found = found.withColumn("_cand", free)

    def bound(m: Column) -> Column:
        out = F.lit(most_sum(LEAST_BITS["mixed"]))
        for name, pattern in reversed(CLASSES.items()):
            out = F.when(m.rlike(pattern), F.lit(most_sum(LEAST_BITS[name]))).otherwise(out)
        return out

    return found.withColumn("entropy", F.filter("_cand", lambda c: least_window_sum(c["m"]) <= bound(c["m"]))).drop("_cand", "_text")


def joined_spans(kinds: list[tuple[int, str, str]], by_start: bool) -> Column:
    """kind:start:end of several span columns, comma-joined in one order: (rank, label, column) each."""
    def rows(rank: int, label: str, column: str) -> Column:
        order = lambda x: (x["s"], F.lit(rank)) if by_start else (F.lit(rank), x["s"])
        return F.transform(
            column, lambda x: F.struct(order(x)[0].alias("a"), order(x)[1].alias("b"), x["s"].alias("s"), x["e"].alias("e"), F.lit(label).alias("k"))
        )

    ordered = F.array_sort(F.concat(*[rows(*kind) for kind in kinds]))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of base spans, and all spans. Edge cases: see scan()."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [(i, k, k) for i, k in enumerate(KINDS[:3])]
    return found.select(
        F.col("_in.doc_id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined_spans(base, True), 256).alias("base_sha256"),
        joined_spans([*base, (3, "entropy", "entropy")], True).alias("spans"),
    )


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT r, 0 AS k, 'assign' AS kind, regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS m,
         string_split_regex(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS g FROM d
  UNION ALL SELECT r, 1, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, 2, 'hex', regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT r, 3, 'entropy', regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(t, '[A-Za-z0-9+/_=-]{20,}') FROM d),
x AS (SELECT r, k, kind, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM f WHERE len(m) > 0),
y AS (SELECT r, k, kind, m, (sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i) - length(m))::BIGINT AS s,
             (sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i))::BIGINT AS e FROM x),
b AS (SELECT * FROM y WHERE
   k = 0 AND length(regexp_replace(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', '')) >= 6
   OR k = 1 AND length(m) >= 20 OR k = 2 AND length(m) >= 24),
c AS (SELECT * FROM y WHERE k = 3 AND NOT regexp_matches(m, '@ALLOWED@')
   AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = y.r AND b.s < y.e AND y.s < b.e)),
v AS (SELECT * FROM c WHERE list_min(list_transform(range(1, length(m) - 18), lambda i:
        list_sum(list_transform(map_values(list_histogram(string_split(substr(m, i, 20), ''))), lambda n: (@SHARES@)[(n + 1)::BIGINT]))))
      <= CASE WHEN regexp_full_match(m, '[0-9]+') THEN @DIGITS@ WHEN regexp_full_match(m, '[0-9a-fA-F]+') AND regexp_matches(m, '[0-9]') THEN @HEX@
              WHEN NOT regexp_matches(m, '[0-9]') THEN @LETTERS@ ELSE @MIXED@ END),
a AS (SELECT * FROM b UNION ALL SELECT * FROM v),
o AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM a GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (r)
""".replace("@ALLOWED@", ALLOWED).replace("@SHARES@", str(SHARES))
for _name, _bits in LEAST_BITS.items():
    OP7_SQL = OP7_SQL.replace(f"@{_name.upper()}@", str(most_sum(_bits)))
