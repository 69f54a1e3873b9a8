"""Archive pages: selector-driven parsing, links, result addresses."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longtext.functions import lexicons as L
from longtext.functions.text import parsed_date, speaker_of

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("p div ul ol li table h1 h2 h3 h4 h5 h6 section article footer header nav aside form blockquote pre".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        todo = list(reversed(self.children))
        while todo:
            n = todo.pop()
            yield n
            if isinstance(n, Node):
                todo.extend(reversed(n.children))

    def text(self, joint: str = " ") -> str:
        parts = [x.strip() for x in self.walk() if isinstance(x, str) and x.strip()]
        return joint.join(parts)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            at = self.now
            while at.parent and at.tag != "p" and at.tag not in ("td", "div", "body", "article"):
                at = at.parent
            if at.tag == "p" and at.parent:
                self.now = at.parent
        n = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(n)
        if tag not in _VOID:
            self.now = n

    def handle_endtag(self, tag):
        at = self.now
        while at.parent and at.tag != tag:
            at = at.parent
        if at.parent:
            self.now = at.parent

    def handle_data(self, data):
        if self.now.tag not in ("script", "style"):
            self.now.children.append(data)


def tree(page: str | None) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


_STEP = re.compile(r"^([a-z0-9]*)((?:\.[\w-]+)*)(?:\[([\w-]+)(\*?=)'([^']*)'\])?$")


def _fits(n: Node, step: str) -> bool:
    m = _STEP.match(step)
    if not m or (m[1] and n.tag != m[1]):
        return False
    names = set(n.attrs.get("class", "").split())
    if any(c not in names for c in m[2].split(".") if c):
        return False
    if m[3]:
        v = n.attrs.get(m[3], "")
        return m[5] in v if m[4] == "*=" else v == m[5]
    return True


def select_one(root: Node, selector: str) -> Node | None:
    """First element that fits a chain of tag.class[attr] steps, each below the one before."""
    steps = selector.split()
    for n in root.walk():
        if not isinstance(n, Node) or not _fits(n, steps[-1]):
            continue
        at, left = n.parent, steps[:-1]
        while at and left:
            if _fits(at, left[-1]):
                left = left[:-1]
            at = at.parent
        if not left:
            return n
    return None


def first_text(root: Node, selectors: tuple[str, ...], with_attributes: bool = False) -> str:
    for s in selectors:
        n = select_one(root, s)
        if n is not None:
            found = (n.attrs.get("datetime") or n.attrs.get("content") if with_attributes else "") or n.text()
            if found:
                return found
    return ""


def content_text(root: Node, selectors: tuple[str, ...]) -> str:
    """Paragraphs of the first content element that has any, joined by blank lines; else all of its text."""
    for s in selectors:
        n = select_one(root, s)
        if n is not None:
            parts = [p.text() for p in n.walk() if isinstance(p, Node) and p.tag == "p"]
            found = "\n\n".join(p for p in parts if p) or n.text("\n")
            if found:
                return found
    return ""


_PARSED = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "date_raw", "location", "person", "content")])


def page_parser(archive: str, selectors: dict | None = None):
    """Arrow function html -> (title, date_raw, location, person, content) for an archive's selectors."""
    s = selectors or L.ARCHIVES[archive]

    @F.pandas_udf(_PARSED)
    def parse(page: pd.Series) -> pd.DataFrame:
        rows = []
        for p in page:
            root = tree(p)
            rows.append((first_text(root, s["title"]), first_text(root, s["date"], archive == "archive_3"), first_text(root, s["location"]), first_text(root, s["person"]), content_text(root, s["content"])))
        return pd.DataFrame(rows, columns=list(_PARSED.names))

    return parse


#: Bytes of pages in one Arrow batch, where the session sets no bound.
BATCH_BYTES = 16 << 20


def bounded_batches(spark) -> None:
    """Bound Arrow batches by bytes where the session does not, so that what a worker holds does not grow with the rows of its task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, str(2**31 - 1)) == str(2**31 - 1):
        spark.conf.set(name, str(BATCH_BYTES))


def documents(pages: DataFrame, archive: str, url: str = "url", page: str = "html", least: int = 200, default_speaker: str | None = None) -> DataFrame:
    """(url, title, date, location, speaker, text) of pages with enough content; the speaker block counts before title and text."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(url, page_parser(archive)(F.col(page)).alias("x")).select(url, "x.*").filter(F.length("content") >= least)
    who = F.coalesce(speaker_of(F.col("person")), speaker_of(F.col("title")), speaker_of(F.substring("content", 1, 800)), F.lit(default_speaker))
    return rows.select(url, "title", parsed_date(F.col("date_raw")).alias("date"), F.nullif("location", F.lit("")).alias("location"), who.alias("speaker"), F.col("content").alias("text"))


def page_text(page: str) -> Column:
    """All text of a page, tags out, by the JVM: for files without known structure."""
    bare = F.regexp_replace(F.regexp_replace(F.col(page), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", "\n")
    plain = bare
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(plain, "[ \t]+", " "), r"\s*\n\s*", "\n")


def title_of(page: Column) -> Column:
    return F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)


def links(page: Column) -> Column:
    """Distinct href values without query and fragment, in page order."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r'href="([^"?#]*)'), F.lit(1)))


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b, h) if b and h is not None else h for b, h in zip(base, href, strict=True)])


def is_document(href: Column) -> Column:
    """Whether a link is a transcript: below /documents/, not a site page or index."""
    slug = F.split(F.split(F.split(href, "/documents/", 2)[1], "/")[0], r"\?")[0]
    index = F.lit(False)
    for p in L.NOT_DOCUMENT_PATTERNS:
        index = index | slug.rlike(p)
    return F.when(href.contains("/documents/") & ~href.contains("app-categories"), ~slug.isin(*L.NOT_DOCUMENTS) & ~index).otherwise(False)


def people(page: Column) -> Column:
    """(id, name) of the options of a person list."""
    ids = F.regexp_extract_all(page, F.lit(r'<option[^>]*value="(\d+)"[^>]*>([^<]*)'), F.lit(1))
    names = F.regexp_extract_all(page, F.lit(r'<option[^>]*value="(\d+)"[^>]*>([^<]*)'), F.lit(2))
    return F.transform(F.arrays_zip(ids.alias("id"), names.alias("name")), lambda x: F.struct(x["id"].alias("id"), F.trim(F.regexp_replace(x["name"], r"\(.*?\)", "")).alias("name")))


def results_url(base: str, person: Column, page: Column, first: Column, last: Column, items: int = 100, categories: tuple[int, ...] = ()) -> Column:
    """Address of one page of results; the page size is one the site accepts."""
    size = min((s for s in (5, 10, 25, 50, 100) if s >= items), default=100)
    parts = [F.lit(f"{base}?items_per_page={size}"), F.concat(F.lit("person2="), person), F.concat(F.lit("from%5Bdate%5D="), F.date_format(first, "MM-dd-yyyy")), F.concat(F.lit("to%5Bdate%5D="), F.date_format(last, "MM-dd-yyyy"))]
    return F.concat_ws("&", *parts, *[F.lit(f"category2%5B%5D={c}") for c in categories], F.concat(F.lit("page="), page.cast("string")))


def pending(pages: DataFrame, done: DataFrame, key: str = "url", per: str | None = None, limit: int | None = None) -> DataFrame:
    """Pages not done yet; with a limit, so many per group in order of the key."""
    from pyspark.sql import Window

    left = pages.join(done.select(key).distinct(), key, "left_anti")
    if limit is None:
        return left
    w = Window.partitionBy(per).orderBy(key) if per else Window.orderBy(key)
    return left.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def people_ids(options: DataFrame) -> DataFrame:
    """(speaker, ids) from rows of one person list (id, name): every option that is one of a speaker's names, or holds it as words of its own.

    The list has one option per person and the names are a constant, so this is a filter per name. An
    option with "w." is never the elder of two speakers who share a name.
    """
    name = F.lower(F.trim(F.col("name")))
    bare = F.trim(F.regexp_replace(name, r"\s*\(.*?\)\s*", ""))
    found = []
    for key, _, names, _, _ in L.SPEAKERS:
        hit = F.lit(False)
        for n in names:
            held = name.rlike(rf"\b{re.escape(n.lower())}\b")
            hit = hit | (bare == n.lower()) | ((held & ~name.contains("w.")) if key == "bush41" else held)
        found.append(F.when(hit, F.lit(key)))
    rows = options.select("id", F.explode(F.array(*found)).alias("speaker")).filter("speaker is not null")
    return rows.groupBy("speaker").agg(F.sort_array(F.collect_set("id")).alias("ids"))
