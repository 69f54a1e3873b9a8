"""Column functions over text; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

ALPHA_WORD = "[A-Za-z']+"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def alpha_words(text: Column) -> Column:
    return found(text, ALPHA_WORD)


def lower_words(text: Column) -> Column:
    return found(F.lower(text), ALPHA_WORD)


def space_words(text: Column) -> Column:
    return found(text, r"(?U)\S+")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_comment_lines(text: Column) -> Column:
    """Every line that starts with # goes; the rest is trimmed."""
    return strip(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.startswith("#")), "\n"))


def split_header(text: Column) -> tuple[Column, Column]:
    """(header, body): the header is the leading run of blank and # lines."""
    lines = F.split(text, "\n")
    body_at = F.array_position(F.transform(lines, lambda x: ~(x.startswith("#") | x.rlike(r"(?U)^\s*$"))), True).cast("int")
    head = F.when(body_at == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(body_at - 1, F.lit(0))))
    body = F.when(body_at == 0, F.lit("")).otherwise(F.array_join(F.slice(lines, F.greatest(body_at, F.lit(1)), F.size(lines)), "\n"))
    return F.regexp_replace(F.array_join(head, "\n"), r"\n+$", ""), body


def is_boilerplate(line: Column) -> Column:
    any_of = F.lit(False)
    for p in L.BOILERPLATE:
        any_of = any_of | line.rlike("(?i)" + p)
    return any_of & ~line.rlike("(?i)" + L.PROTECTED)


def normalized(text: Column) -> Column:
    """Boilerplate lines out, blanks collapsed, plain quotes and dashes, one newline at the end."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(strip(x), "[ \t]+", " "))
    kept = F.array_join(F.filter(lines, lambda x: (x == "") | ~is_boilerplate(x)), "\n")
    plain = F.translate(F.regexp_replace(kept, "\n{3,}", "\n\n"), "‘’“”– ", "''\"\"- ")
    return F.concat(strip(F.replace(plain, F.lit("—"), F.lit("--"))), F.lit("\n"))


def sentences(text: Column) -> Column:
    """Split after . ! ? before a capital, digit, quote or bracket; trimmed, empty ones out."""
    parts = F.split(F.regexp_replace(text, r"\s+", " "), SENTENCE_BREAK)
    return F.filter(F.transform(parts, F.trim), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda x: x.rlike(r"\S"))


def count_labels(text: Column, pattern: str, ignore_case: bool) -> Column:
    """Matches of a line label; ^ follows newlines only."""
    return F.regexp_count(text, F.lit(("(?imd)" if ignore_case else "(?md)") + pattern))


def question_answer_ratio(questions: Column, answers: Column) -> Column:
    return F.when(answers > 0, questions / answers).otherwise(questions.cast("double"))


def median_of(numbers: Column) -> Column:
    s, n = F.array_sort(numbers), F.size(numbers)
    low, high = F.get(s, ((n - 1) / 2).cast("int")), F.get(s, (n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)


def mean_of(numbers: Column) -> Column:
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))


def syllables(words: Column) -> Column:
    """Vowel groups of all words, at least one each: a heuristic in place of a pronouncing dictionary."""
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.greatest(F.lit(1), F.regexp_count(w, F.lit("(?i)[aeiouy]+"))))


def reading_ease(words: Column, sents: Column, syll: Column) -> Column:
    return F.when((words >= 20) & (sents > 0), 206.835 - 1.015 * (words / sents) - 84.6 * (syll / words))


def grade_level(words: Column, sents: Column, syll: Column) -> Column:
    return F.when((words >= 20) & (sents > 0), 0.39 * (words / sents) + 11.8 * (syll / words) - 15.59)


def count_in(words: Column, lexicon: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*lexicon)))


def hedge_phrases(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?i)\b(" + "|".join(L.HEDGE_PHRASES) + r")\b"))


def study_features(words: Column, most: int = L.STUDY_WORDS) -> dict[str, Column]:
    """Counts over the first `most` lower-case words."""
    first = F.slice(words, 1, most)
    things, fillers = F.size(F.filter(first, lambda w: w.contains("thing"))), count_in(first, L.STUDY_FILLERS)
    return {"ns_nouns": things, "fillers": fillers, "ns_plus_fillers": things + fillers, "li_verbs": count_in(first, L.STUDY_VERBS)}


def hash_of_normalized(text: Column) -> Column:
    return F.sha1(F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")))


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k lower-case words; none if there are fewer."""
    words = found(F.lower(text), r"(?U)\w+")
    made = lambda w: F.when(F.size(w) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " ")))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(words), made)[0]


def stable_id(source: Column, url: Column, date: Column) -> Column:
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(source, F.lit("_"), F.substring(F.sha1(F.concat_ws("|", empty(source), empty(url), empty(date))), 1, 16))


_ACCENTS = {"a": "áàâäãåāăą", "e": "éèêëēĕėęě", "i": "íìîïīĭį", "o": "óòôöõōŏő", "u": "úùûüūŭůűų", "c": "çćĉċč", "n": "ñńņň", "y": "ýÿŷ", "s": "śŝşš", "z": "źżž"}


def slug(text: Column, most: int = 60) -> Column:
    """ASCII slug. Accented Latin letters lose their marks by a table; use udfs.nfkd_ascii first for full decomposition."""
    marked, plain = "".join(_ACCENTS.values()), "".join(k * len(v) for k, v in _ACCENTS.items())
    low = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), marked, plain), r"[^\x00-\x7F]", "")
    cut = F.substring(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return F.coalesce(F.nullif(F.regexp_replace(cut, "^-+|-+$", ""), F.lit("")), F.lit("untitled"))


def file_name(date: Column, speaker: Column, source: Column, title: Column) -> Column:
    day = F.coalesce(F.nullif(date.cast("string"), F.lit("")), F.lit("0000-00-00"))
    return F.concat(F.concat_ws("_", day, speaker, source, slug(title)), F.lit(".txt"))


def parsed_date(raw: Column) -> Column:
    """Date from the usual written forms, else null; a year is required."""
    s = F.trim(raw)
    long_form = F.regexp_extract(s, r"(?i)((?:january|february|march|april|may|june|july|august|september|october|november|december) \d{1,2}, ?\d{4})", 1)
    iso = F.regexp_extract(s, r"(\d{4}-\d{2}-\d{2})", 1)
    forms = [(iso, "yyyy-MM-dd"), (F.initcap(F.regexp_replace(long_form, ", ?", ", ")), "MMMM d, yyyy"), (s, "MM/dd/yyyy"), (s, "d MMMM yyyy"), (s, "MMM d, yyyy")]
    return F.coalesce(*[F.try_to_date(F.nullif(x, F.lit("")), f) for x, f in forms])


def date_in_name(name: Column) -> Column:
    p = r"(20\d{2})[-_]?(\d{2})[-_]?(\d{2})"
    return F.try_to_date(F.nullif(F.concat_ws("-", *[F.regexp_extract(name, p, i) for i in (1, 2, 3)]), F.lit("--")), "yyyy-MM-dd")


def to_bool(value: Column) -> Column:
    s = F.trim(value)
    return F.when(s.isin("1", "true", "True", "yes"), True).when(s.isin("0", "false", "False", "no"), False)


def to_number(value: Column) -> Column:
    return F.trim(value).try_cast("double")


def speaker_of(text: Column) -> Column:
    """Key of the first speaker of the list, in its order, with a name in the text."""
    low, out = F.lower(text), None
    for key, _, names, _, _ in L.SPEAKERS:
        hit = F.lit(False)
        for n in names:
            hit = hit | low.contains(n.lower())
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out


def neutral_code(key: Column, date: Column) -> Column:
    late = F.coalesce(date.cast("string") >= L.SPLIT_DATE, F.lit(False))
    out = F.when(key == L.SPLIT_KEY, F.when(late, L.SPLIT_CODES[1]).otherwise(L.SPLIT_CODES[0]))
    for k, code in L.CODES.items():
        out = out.when(key == k, code)
    return out.otherwise("?")


def neutral_label(key: Column, date: Column) -> Column:
    return F.concat(F.lit("President "), neutral_code(key, date))


def code_name(code: Column) -> Column:
    out = None
    for k, name in L.CODE_NAMES.items():
        out = F.when(code == k, name) if out is None else out.when(code == k, name)
    return out
