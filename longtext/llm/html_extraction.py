"""HTML extraction by a recurrent block labeller: a bidirectional LSTM in numpy classifies every block of a page."""

from __future__ import annotations

import html
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .jaccard_join import U, word_hashes

# Element kinds of HTML.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table"
    " tbody td textarea tfoot th thead tr ul label title head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head noscript template iframe object svg math canvas audio video title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: An element that ends an open one of these when it starts inside it.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Elements that an end tag or an implied end does not reach through.
WALLS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
NOT_IN_P = BLOCK - {"button", "label", "option", "optgroup", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PIECE = re.compile(r"[a-z]+")

PATH, WORDS, PLAIN = 160, 64, 8
WIDTH = PATH + WORDS + PLAIN
HIDDEN_UNITS = 24
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "models", "blocks.npz")


class Block:
    __slots__ = ("path", "parts", "linked", "chars")

    def __init__(self, path: tuple):
        self.path, self.parts, self.linked, self.chars = path, [], 0, 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def blocks_of(page: str) -> list[tuple[tuple, str, float]]:
    """Leaf blocks of a page in order: (tag path, text, share of it in links).

    A block is the text between two borders of block-level elements. References are decoded, white
    space runs are one space, br counts as white space. Unclosed elements end where HTML ends them.
    """
    out: list[tuple[tuple, str, float]] = []
    stack: list[tuple[str, tuple]] = []
    hidden, links, now = 0, 0, None

    def close() -> None:
        nonlocal now
        if now is not None:
            if text := now.text():
                out.append((now.path, text, now.linked / max(1, now.chars)))
            now = None

    def pop_to(n: int) -> None:
        nonlocal hidden, links
        for name, _ in stack[n:]:
            hidden -= name in HIDDEN
            links -= name == "a"
        del stack[n:]

    at, end = 0, len(page)
    lower = None
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                continue
            if not hidden:
                if now is None:
                    if not piece.strip():
                        continue
                    now = Block(tuple(x for _, names in stack for x in names))
                now.parts.append(piece)
                n = len(piece)
                now.chars += n
                if links:
                    now.linked += n
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                close()
            if name == "br" and now is not None:
                now.parts.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
                if stack[i][0] in WALLS.get(name, ()) or (name not in BLOCK and stack[i][0] in ("td", "th", "table")):
                    break
            continue
        if name in BLOCK:
            close()
            if name in ENDS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in WALLS[name]:
                        break
                    if stack[i][0] in ENDS[name]:
                        pop_to(i)
            if name in NOT_IN_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] in ("td", "th", "table", "button"):
                        break
            if name == "body":
                for i, (open_name, _) in enumerate(stack):
                    if open_name == "head":
                        pop_to(i)
                        break
        if name == "br" and now is not None:
            now.parts.append(" ")
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCK and name not in RAW:
            continue
        names = [name]
        if m[3]:
            for a in NAMES.finditer(m[3]):
                names += [f"={x}" for x in PIECE.findall((a[1] or a[2] or a[3] or "").lower())]
        stack.append((name, tuple(names)))
        hidden += name in HIDDEN
        links += name == "a"
        if name in RAW:
            lower = page.lower() if lower is None else lower
            stop = lower.find(f"</{name}", at)
            stop = end if stop < 0 or len(lower) != end else stop
            if name == "textarea" and not hidden and page[at:stop].strip():
                now = now or Block(tuple(x for _, names in stack for x in names))
                now.parts.append(page[at:stop])
            at = stop
    close()
    return out


_PATHS: dict[tuple, np.ndarray] = {}


def path_vector(path: tuple) -> np.ndarray:
    """Hashed tag path: each tag and each word of its class, id and role adds to one place; the last three tags also to another."""
    found = _PATHS.get(path)
    if found is None:
        found = np.zeros(PATH, np.float32)
        for x in path:
            found[zlib.crc32(x.encode()) % (PATH - 16)] += 1
        for x in [x for x in path if x[0] != "="][-2:]:
            found[PATH - 16 + zlib.crc32(b"leaf " + x.encode()) % 16] += 1
        found = np.minimum(found, 2)
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        _PATHS[path] = found
    return found


def page_matrix(blocks: list[tuple[tuple, str, float]]) -> np.ndarray:
    """One row of inputs for each block."""
    x = np.zeros((len(blocks), WIDTH), np.float32)
    words, offsets = word_hashes([b[1] for b in blocks])
    owner = np.repeat(np.arange(len(blocks)), np.diff(offsets))
    many = np.maximum(1, np.diff(offsets))
    if len(words):
        sign = np.where((words >> U(8)) & U(1), 1.0, -1.0)
        flat = np.bincount(owner * WORDS + (words >> U(58)).astype(np.int64), sign, len(blocks) * WORDS)
        x[:, PATH : PATH + WORDS] = flat.reshape(-1, WORDS) / np.sqrt(many)[:, None]
    for i, (path, text, linked) in enumerate(blocks):
        x[i, :PATH] = path_vector(path)
        n = len(text)
        x[i, PATH + WORDS :] = (
            np.log1p(many[i]) / 4,
            np.log1p(n) / 6,
            linked,
            min(1.0, 10 * sum(map(text.count, ".!?,;")) / n),
            i / max(1, len(blocks) - 1),
            np.log1p(len(blocks)) / 5,
            text[-1] in ".!?:\"”",
            min(1.0, len(path) / 20),
        )
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def start_weights(seed: int = 3) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(seed), HIDDEN_UNITS
    w = {}
    for side in "fb":
        w[f"w{side}"] = rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * h))
        w[f"u{side}"] = rng.normal(0, h**-0.5, (h, 4 * h))
        w[f"c{side}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
    w["out"], w["bias"] = rng.normal(0, h**-0.5, 2 * h), np.zeros(1)
    return w


def run_side(x: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray, keep: bool = False):
    """Hidden states (T, B, H) of one direction over padded inputs (T, B, WIDTH)."""
    steps, batch, h = x.shape[0], x.shape[1], HIDDEN_UNITS
    drive = x.reshape(steps * batch, -1) @ w
    drive = drive.reshape(steps, batch, 4 * h) + c
    out, state = np.zeros((steps, batch, h), x.dtype), np.zeros((batch, h), x.dtype)
    hidden, kept = np.zeros((batch, h), x.dtype), []
    for t in range(steps):
        z = drive[t] + hidden @ u
        gates, new = sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
        before = state
        state = gates[:, h : 2 * h] * state + gates[:, :h] * new
        squashed = np.tanh(state)
        previous, hidden = hidden, gates[:, 2 * h :] * squashed
        out[t] = hidden
        if keep:
            kept.append((gates, new, before, squashed, previous))
    return out, kept


def backward_side(x, d_out, kept, u):
    """Gradients of (w, u, c) for one direction from those of its hidden states."""
    h, steps = HIDDEN_UNITS, x.shape[0]
    du, dz_all = np.zeros_like(u), np.zeros((steps, x.shape[1], 4 * h))
    dh, ds = np.zeros(d_out.shape[1:]), np.zeros(d_out.shape[1:])
    for t in range(steps - 1, -1, -1):
        gates, new, before, squashed, previous = kept[t]
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        dh = dh + d_out[t]
        ds = ds + dh * o * (1 - squashed**2)
        dz = np.concatenate([ds * new * i * (1 - i), ds * before * f * (1 - f), dh * squashed * o * (1 - o), ds * i * (1 - new**2)], axis=1)
        dz_all[t] = dz
        du += previous.T @ dz
        dh, ds = dz @ u.T, ds * f
    flat = dz_all.reshape(-1, 4 * h)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, reversed, mask): inputs (T, B, WIDTH) padded at the end, each page also reversed on its own length."""
    most = max(len(p) for p in pages)
    x, y, mask = np.zeros((most, len(pages), WIDTH), pages[0].dtype), np.zeros((most, len(pages), WIDTH), pages[0].dtype), np.zeros((most, len(pages)), bool)
    for b, p in enumerate(pages):
        x[: len(p), b], y[: len(p), b], mask[: len(p), b] = p, p[::-1], True
    return x, y, mask


def turned(side: np.ndarray, pages: list[np.ndarray]) -> np.ndarray:
    out = np.zeros_like(side)
    for b, p in enumerate(pages):
        out[: len(p), b] = side[: len(p), b][::-1]
    return out


def label_blocks(pages: list[np.ndarray], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page (matrix of inputs, at least one row), the chance of each block to be main text."""
    x, y, _ = padded(pages)
    f, _ = run_side(x, w["wf"], w["uf"], w["cf"])
    b, _ = run_side(y, w["wb"], w["ub"], w["cb"])
    score = f @ w["out"][:HIDDEN_UNITS] + turned(b, pages) @ w["out"][HIDDEN_UNITS:] + w["bias"]
    return [sigmoid(score[: len(p), i]) for i, p in enumerate(pages)]


_MODEL: dict = {}


def model() -> dict[str, np.ndarray]:
    if not _MODEL:
        with np.load(WEIGHTS) as found:
            _MODEL.update({k: found[k].astype(np.float32) for k in found.files})
    return _MODEL


def main_texts(pages: list[str | None], w: dict[str, np.ndarray] | None = None, most: int = 20_000) -> list[str]:
    """Main text of each page: the blocks labelled as such, in page order, joined by newlines. `most` padded blocks are labelled at once, or one page."""
    w = model() if w is None else w
    parsed = [blocks_of(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, p in enumerate(parsed) if p), key=lambda i: len(parsed[i]))
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * len(parsed[order[at + n]]) <= most and n < 256:
            n += 1
        rows = order[at : at + n]
        for i, chance in zip(rows, label_blocks([page_matrix(parsed[i]) for i in rows], w), strict=True):
            out[i] = "\n".join(b[1] for b, p in zip(parsed[i], chance.tolist(), strict=True) if p > 0.5)
        at += n
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without main text, give the empty text. Rows are independent: repeated
    rows give equal rows, and no page waits for others beyond its Arrow batch.
    """
    ship(pages.sparkSession)
    with open(WEIGHTS, "rb") as f:
        sent = pages.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        with np.load(io.BytesIO(sent.value)) as found:
            w = {k: found[k].astype(np.float32) for k in found.files}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = main_texts(part.column(2).to_pylist(), w)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["k", "url", "text"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("url"), F.col(page).alias("page"))
    made = rows.mapInArrow(run, f"k {kind}, url string, text string")
    return made.select(F.col("k").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
