"""N-gram Jaccard join by T-occurrence search over inverted lists."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longtext.operators.components import connected_components

from .common import carried, join_small, returned, ship, small_enough, stage_table, table, tidy, tidy_group
from .tokens import balanced, forget

WORDS = 4
PERCENT = 85
#: Inverted lists of more documents than this are long; their shingles come last in every document's order.
LONG = 32
#: Most long shingles that are sent to all tasks (8 bytes each). Which shingles come last is only an
#: order: beyond the bound the longest lists are named, and results stay the same.
MOST_LONG = 2_000_000
#: Shingles that one task of the counting and the joining step holds, about.
RANGE_TOKENS = 2_000_000
#: Documents whose texts may be named to all tasks to pick their sets; beyond it a join picks them.
MOST_PICKED = 2_000_000
#: Rows of two longs (pairs, labels, keys of dropped rows) that may be sent to all tasks.
MOST_KEYS = 500_000
#: Rounds in which each document meets one partner of another component, before all partners that are still apart.
ROUNDS = 3
#: Signature lists in which a document looks for its partner of a round: those of its least signatures by hash, which similar documents share.
PARTNER_LISTS = 8
#: Parts of a group of a document's shingles; any three of four make a signature.
PARTS = 4
#: Buckets of the histograms by which distant pairs are told before their sets are fetched.
BUCKETS = 128
#: Pairs out of signature lists that a task gathers before it joins the repeated ones, about.
GATHERED = 2_000_000

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_GOLD = 0x9E3779B97F4A7C15
_BYTE = _mix((np.arange(1, 257, dtype=U)) * U(_GOLD))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP, _BACK = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 2**64)
_FOLD = [U(pow(0xC2B2AE3D27D4EB4F, k, 2**64)) for k in range(64)]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _STEP), ("down", _BACK)):
            x = np.full(n, base, dtype=U)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=U)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all parts, in order, and the number of words before each part.

    One pass over the bytes: running sums of byte values times powers give every word's polynomial.
    """
    joined = "\n".join(parts).encode("utf-8", "surrogatepass")
    data = np.frombuffer(joined, dtype=np.uint8)
    blank = np.ones(len(data) + 2, dtype=bool)
    blank[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(data):
        up, down = _powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * up[: len(data)], dtype=U)])
        words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(_GOLD))
    else:
        words = np.zeros(0, dtype=U)
    sizes = np.array([len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts], dtype=np.int64)
    return words, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = words[:n].copy()
    for j in range(1, k):
        total += words[j : n + j] * _FOLD[j]
    return _mix(total + U(k))


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    hashes = np.sort(hashes)
    if len(hashes) < 2:
        return hashes
    new = np.empty(len(hashes), bool)
    new[0] = True
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    return hashes[new]


def shingle_set(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; of the whole sequence if it is shorter."""
    return distinct(shingles_of(words, min(k, len(words)))) if len(words) else words


def shingle_sets(texts: pa.Array, k: int = WORDS, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, shingle set) of every text; null counts as empty. Works through `most` bytes at a time."""
    forget()
    at, held = -1, []
    for rows, parts in balanced(texts, most):
        words, offsets = word_hashes(parts)
        hashes, rows, ends = shingles_of(words, k), rows.tolist(), offsets.tolist()
        for j, row in enumerate(rows):
            if row != at and held:
                yield at, shingle_set(np.concatenate(held), k)
                held = []
            x, y = ends[j], ends[j + 1]
            if not held and y - x >= k and j + 1 < len(rows) and rows[j + 1] != row:  # the whole text is here
                yield row, distinct(hashes[x : y - k + 1])
            else:
                at = row
                held.append(words[x:y])
    if held:
        yield at, shingle_set(np.concatenate(held), k)


def fingerprint(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set: sums of two mixes, folded."""
    if not len(shingles):
        return 0
    one, two = int(_mix(shingles + U(1)).sum(dtype=U)), int(_mix(shingles ^ U(_GOLD)).sum(dtype=U))
    x = (one * _STEP + two + len(shingles)) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    x ^= x >> 31
    return x - 2**64 if x >= 2**63 else x


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    """So many of its shingles, in any common order, hold one that each partner's as many also hold."""
    return n - (-(-percent * n // 100)) + 1


def described(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, f, h): size and fingerprint of each row's set, hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, s in shingle_sets(batch.column(1), k):
                n[i], f[i] = len(s), fingerprint(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(f)], names=["k", "h", "n", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(tidy(run), f"k {kind}, h long, n long, f long")
    return made.select(F.col("k").alias("doc_id"), F.col("n").alias("n_shingles"), "f", "h")


class Dealer:
    """Collects items by ranges of a 64-bit hash and yields (range, bytes) rows when enough are held."""

    def __init__(self, bits: int, kind: np.dtype, most: int = 250_000):
        self.bits, self.kind, self.most, self.held, self.n = bits, kind, most, [], 0

    def add(self, items: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(items)
        self.n += len(items)
        if self.n >= self.most:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        items = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        self.held, self.n = [], 0
        if self.kind.names:
            keys = (items["t"] >> U(64 - self.bits)).astype(np.uint16 if self.bits <= 16 else np.uint32)
            order = np.argsort(keys, kind="stable")
            items, keys = items[order], keys[order]
        else:
            items = np.sort(items)
            keys = items >> U(64 - self.bits)
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
        blocks = [items[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        if not self.kind.names:  # the range is known: 32 further bits are enough to tell lists apart
            blocks = [(b >> U(32 - self.bits)).astype(np.uint32) for b in blocks]
        return pa.RecordBatch.from_arrays([pa.array(keys[cuts[:-1]].astype(np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["r", "block"])


#: k: shingles on long lists, of documents that have them in their prefix; -1 for others.
POSTING = np.dtype([("t", "<u8"), ("c", "<i8"), ("n", "<i4"), ("k", "<i4")])
#: A posting of a document whose component is known; e marks the lists in which the document looks for a partner.
NAMED = np.dtype([("t", "<u8"), ("c", "<i8"), ("n", "<i4"), ("k", "<i4"), ("l", "<i8"), ("e", "u1")])


def shape(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The leading 32 + bits bits, by which lists are told apart when they are counted."""
    return tokens >> U(32 - bits)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of each run of equal keys."""
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return firsts, np.diff(np.concatenate([firsts, [len(keys)]]))


def postings(blocks: pd.Series, kind: np.dtype) -> np.ndarray:
    """Different postings of all blocks by shingle, then name."""
    items = np.concatenate([np.frombuffer(b, kind) for b in blocks])
    items = items[np.lexsort((items["c"], items["t"]))]
    return items[np.concatenate([[True], items[1:] != items[:-1]])] if len(items) else items


def long_lists(docs: DataFrame, bits: int, k: int, long: int) -> DataFrame:
    """(t, df): leading bits of the shingles that more than `long` documents hold; every document counts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, seen = Dealer(bits, np.dtype("<u8")), set()
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                f = fingerprint(s)
                if len(s) and f not in seen:  # copies in one partition count once
                    seen.add(f)
                    yield from dealer.add(s)
        yield dealer.flush()

    def count(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        items = np.sort(np.concatenate([np.frombuffer(b, np.uint32) for b in blocks["block"]]))
        firsts, many = runs(items)
        pick = many > long
        return pd.DataFrame({"t": (np.int64(key[0]) << np.int64(32)) + items[firsts[pick]].astype(np.int64), "df": many[pick]})

    return docs.select("text").mapInArrow(tidy(deal), "r int, block binary").groupBy("r").applyInPandas(tidy_group(count), "t long, df long")


def met_lists(docs: DataFrame, bits: int, k: int, percent: int, long: int, long_tokens, sure: bool) -> DataFrame:
    """(cs, ns, ks, w): the short inverted lists of the documents' prefixes, names and sizes of their documents, with the number of
    shingles that have just that list; and (cs, null, ks, null) for the documents of a longer list. ks are the numbers of
    shingles on long lists (see POSTING); they are exact if sure, where all longer lists are named, and no less otherwise.

    A document's shingles are ordered short lists first, by hash; the first n - T + 1 of them, its prefix, make the lists that
    have to be merged: two documents that reach the overlap T meet in one of them.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, dealer, seen = long_tokens.value, Dealer(bits, POSTING), set()
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                f = fingerprint(s)
                if not len(s) or f in seen:
                    continue
                seen.add(f)
                p, lead = prefix_length(len(s), percent), shape(s, bits)
                at = np.minimum(np.searchsorted(common, lead), max(len(common) - 1, 0))
                last = common[at] == lead if len(common) else np.zeros(len(s), bool)
                cold = s[~last]
                out = np.zeros(p, POSTING)
                out["t"] = np.concatenate([cold[:p], s[last][: max(0, p - len(cold))]])
                out["c"], out["n"] = f, len(s)
                # where lists beyond `long` are not all named, any prefix may reach one: no document may be ruled out by its k
                out["k"] = len(s) if not sure else -1 if len(cold) >= p else len(s) - len(cold)
                yield from dealer.add(out)
        yield dealer.flush()

    def meet(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        items = postings(blocks["block"], POSTING)  # copies fall together
        firsts, many = runs(items["t"])
        found: dict = {}
        for x, m in zip(firsts[(many > 1) & (many <= long)].tolist(), many[(many > 1) & (many <= long)].tolist(), strict=True):
            found.setdefault(items["c"][x : x + m].tobytes(), [items[x : x + m], 0])[1] += 1
        rows = [(x["c"].tolist(), x["n"].tolist(), x["k"].tolist(), w) for x, w in found.values()]
        hot = [items[["c", "k"]][x : x + m] for x, m in zip(firsts[many > long], many[many > long], strict=True)]
        if hot:
            hot = np.unique(np.concatenate(hot))
            rows.append((hot["c"].tolist(), None, hot["k"].tolist(), None))
        return pd.DataFrame(rows, columns=["cs", "ns", "ks", "w"]).astype({"w": "Int64"})

    dealt = docs.select("text").mapInArrow(tidy(deal), "r int, block binary")
    return dealt.groupBy("r").applyInPandas(tidy_group(meet), "cs array<long>, ns array<int>, ks array<int>, w long")


def needed(na: int, nb: int, ka: int, kb: int, percent: int) -> int:
    """So many short-list shingles two documents show in their prefixes at least when they reach the similarity.

    That is the overlap less what can lie behind the longer prefix; or, where all short-list shingles of both are in their
    prefixes and long lists cannot make the overlap, less what they can share on long lists.
    """
    overlap = -(-percent * (na + nb) // (100 + percent))
    if ka >= 0 and kb >= 0 and min(ka, kb) < overlap:
        return overlap - min(ka, kb)
    return max(1, overlap - (-(-percent * max(na, nb) // 100) - 1))


def merge_skip(lists: list[list[int]], weights: list[int], least: int) -> list[tuple[int, int]]:
    """(id, weight) of the ids whose lists weigh `least` or more together: a heap merge of sorted lists that skips.

    Where the least id weighs too little, further lists are popped as long as all popped ones together weigh too
    little; no id before the next head can reach the bound, so they all go on to it by binary search.
    """
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapify(heap)
    at, out = [0] * len(lists), []
    while heap:
        head, total, popped = heap[0][0], 0, []
        while heap and heap[0][0] == head:
            popped.append(heappop(heap)[1])
            total += weights[popped[-1]]
        if total >= least:
            out.append((head, total))
            goal = head + 1
        else:
            while heap and total + weights[heap[0][1]] < least:
                popped.append(heappop(heap)[1])
                total += weights[popped[-1]]
            if not heap:
                break
            goal = heap[0][0]
        for i in popped:
            at[i] = bisect_left(lists[i], goal, at[i])
            if at[i] < len(lists[i]):
                heappush(heap, (lists[i][at[i]], i))
    return out


def merged(lists: DataFrame, bits: int, percent: int) -> DataFrame:
    """(a, b, o), a < b: for each document the others that its short lists show often enough, by merging the lists."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        c, n, k, w = (rows.column(x).to_numpy() for x in ("c", "n", "k", "w"))
        lists = [rows.column(x).combine_chunks() for x in ("cs", "ns", "ks")]
        ends = lists[0].offsets.to_numpy()
        ids, sizes, commons = (x.values.to_numpy(zero_copy_only=False) for x in lists)
        order = np.argsort(c, kind="stable")
        firsts, many = runs(c[order])
        out = []
        for x, m in zip(firsts.tolist(), many.tolist(), strict=True):
            at = order[x : x + m]
            of, size, common = int(c[at[0]]), int(n[at[0]]), int(k[at[0]])
            lists, known = [], {}
            for i in at.tolist():
                part = ids[ends[i] : ends[i + 1]].tolist()
                lists.append(part)
                known.update(zip(part, zip(sizes[ends[i] : ends[i + 1]].tolist(), commons[ends[i] : ends[i + 1]].tolist(), strict=True), strict=True))
            least = {b: needed(size, nb, common, kb, percent) for b, (nb, kb) in known.items() if 100 * min(size, nb) >= percent * max(size, nb)}
            if least:
                for b, o in merge_skip(lists, w[at].tolist(), min(least.values())):
                    if o >= least.get(b, o + 1):
                        out.append((of, b, o))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["a", "b", "o"])

    whole = lists.filter("w is not null").groupBy("cs", "ns", "ks").agg(F.sum("w").alias("w"))
    each = whole.select("cs", "ns", "ks", "w", F.posexplode("cs").alias("i", "c")).filter(F.col("i") < F.size("cs") - 1)
    later = lambda x: F.slice(x, F.col("i") + 2, F.size(x) - F.col("i") - 1)
    mine = [F.get(x, F.col("i")).alias(x[0]) for x in ("ns", "ks")]
    each = each.select(F.pmod(F.xxhash64("c"), F.lit(2**bits)).alias("r"), "c", *mine, *[later(x).alias(x) for x in ("cs", "ns", "ks")], "w")
    return each.groupBy("r").applyInArrow(tidy_group(run), "a long, b long, o long")


def picked_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(c, n, s, z): shingle set, as bytes, its size and histogram, of each wanted document (columns c, h: its name and its text's hash)."""
    wanted = stage_table(wanted, "jaccard-wanted")
    rows = docs.select(F.xxhash64("text").alias("h"), "text")
    rows = rows.join(F.broadcast(wanted) if small_enough(wanted, MOST_PICKED) else wanted, "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                names, out = part.column(0).to_pylist(), []
                for i, s in shingle_sets(part.column(1), k):
                    if names[i] not in seen and fingerprint(s) == names[i]:
                        seen.add(names[i])
                        z = np.minimum(np.bincount((s >> U(57)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)
                        out.append((names[i], len(s), s.tobytes(), z.tobytes()))
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["c", "n", "s", "z"]
                )

    return rows.select("c", "text").mapInArrow(tidy(run), "c long, n int, s binary, z binary").dropDuplicates(["c"])


def size_class(n: int, percent: int) -> int:
    """Number of a size's class: sizes of similar sets lie in one class or in neighbours."""
    at, bound = 0, 1
    while True:
        bound = bound * 100 // percent + 1
        if n < bound:
            return at
        at += 1


def most_apart(at: int, percent: int) -> int:
    """Most shingles in which similar sets differ, the smaller one's size being of class `at`."""
    bound = 1
    for _ in range(at + 1):
        bound = bound * 100 // percent + 1
    least = bound - 1
    return (100 - percent) * (least + least * 100 // percent) // (100 + percent)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of which two similar, different sets share one at least.

    For the smaller set's size class, similar sets differ in K shingles at most. Shingles are dealt by hash over
    K // 2 + 1 groups of PARTS parts: in some group no more than one part can differ, so the other three are
    equal. Each signature names three parts of a group. A set may be the smaller or the larger of a
    pair: it has signatures for its own class and for the one below.
    """
    out, own = [], size_class(len(s), percent)
    for at in (own, own - 1):
        apart = most_apart(at, percent) if at >= 0 else 0
        if not apart:
            continue
        groups = apart // 2 + 1
        part = (_mix(s ^ U(_GOLD * (at + 1) % 2**64)) % U(PARTS * groups)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sums = np.concatenate([np.zeros(1, U), np.cumsum(_mix(s[order] + U(at)), dtype=U)])
        cuts = np.searchsorted(part[order], np.arange(PARTS * groups + 1))
        parts = (sums[cuts[1:]] - sums[cuts[:-1]]).reshape(groups, PARTS)
        without = (parts.sum(axis=1, dtype=U)[:, None] - parts).ravel()
        out.append(_mix(without + _mix(np.arange(PARTS * groups, dtype=U) * U(_GOLD) + U(at + 1))))
    return np.concatenate(out) if out else np.zeros(0, U)


def range_bits(items: int, least: int = 1) -> int:
    """Bits of the hash that make ranges of about RANGE_TOKENS items."""
    return min(26, max(least, int(np.ceil(np.log2(max(1, items) / RANGE_TOKENS + 1)))))


def signature_bits(sets: DataFrame) -> int:
    """Ranges for the signatures of these sets: a set has fewer than its shingles and 16.

    Two sets share many lists, and each range that holds one of these names the pair: no more ranges than the lists fill.
    """
    told = sets.agg(F.sum(F.col("n").cast("long")), F.count("*")).first()
    return range_bits((told[0] or 0) + 16 * told[1])


def joined_pairs(found: list[np.ndarray]) -> np.ndarray:
    """Rows (x, y, o) of the list as different rows (a, b, o), a < b, o added up."""
    pairs = np.concatenate(found)
    frame = pd.DataFrame({"a": pairs[:, :2].min(axis=1), "b": pairs[:, :2].max(axis=1), "o": pairs[:, 2]})
    return frame.groupby(["a", "b"], sort=False)["o"].sum().reset_index().to_numpy(np.int64)


def signature_lists(sets: DataFrame, bits: int, percent: int, mode: str, turn: int = 0) -> DataFrame:
    """(a, b, o) pairs out of the lists of signatures, with the number of lists. sets: c, n, k, s, and l, its component.

    Pairs whose long-list shingles cannot make the overlap are left out: their short-list shingles show them (see needed()).

    Modes: "stars" gives each member with its list's least. The others pass over lists whose members are all of one
    component: "next" orders each list by a hash of its own and gives each member with the next one of another component; "all" gives
    members outside the list's largest component with all members of the others. In "stars" and "next" a member
    speaks in PARTNER_LISTS of its lists only, so a document makes that many pairs at most, however many signatures it has;
    one pair of every list of several components stays (with o = 0 if it cannot link): it tells that components are apart.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(bits, NAMED)
        for batch in batches:
            for c, n, k, s, named in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                t = signatures(np.frombuffer(s, "<u8"), percent)
                out = np.zeros(len(t), NAMED)
                out["t"], out["c"], out["n"], out["k"], out["l"] = t, c, n, k, named
                mixed = _mix(t)  # the ranges follow t itself
                out["e"] = mixed <= np.sort(mixed)[min(PARTNER_LISTS, len(t)) - 1] if len(t) else 0
                yield from dealer.add(out)
        yield dealer.flush()

    def meet(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        items = postings(blocks["block"], NAMED)
        firsts, many = runs(items["t"])
        found, held = [np.zeros((0, 3), np.int64)], [0, GATHERED]  # rows held, and how many are too many

        def add(x: np.ndarray, y: np.ndarray, keep_all: bool = False) -> None:
            n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
            fit = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * np.minimum(x["k"], y["k"]).astype(np.int64) >= percent * (n + m))
            part = np.stack(np.broadcast_arrays(x["c"], y["c"], fit.astype(np.int64)), axis=1)
            found.append(part if keep_all else part[fit])
            held[0] += len(found[-1])
            if held[0] > held[1]:
                found[:] = [joined_pairs(found)]
                held[:] = [len(found[0]), GATHERED + 2 * len(found[0])]

        for x, m in zip(firsts[many > 1].tolist(), many[many > 1].tolist(), strict=True):
            rows = items[x : x + m]
            if mode == "stars":
                add(rows[:1], rows[1:][rows["e"][1:] == 1])
                continue
            names, inverse, size = np.unique(rows["l"], return_inverse=True, return_counts=True)
            if len(names) == 1:
                continue
            if mode == "next":
                ring = rows[np.argsort(_mix(rows["c"].view(U) ^ rows["t"] ^ U(_GOLD * turn % 2**64)))]
                last = np.flatnonzero(ring["l"] != np.roll(ring["l"], -1))  # the next member is of another component
                partner = ring[(last[np.searchsorted(last, np.arange(m)) % len(last)] + 1) % m]
                speaks = ring["e"] == 1
                speaks[0] = True
                add(ring[speaks], partner[speaks], True)
                continue
            largest = np.argmax(size)
            for i in np.flatnonzero(inverse != largest).tolist():
                add(rows[i : i + 1], rows[(inverse == largest) | (inverse < inverse[i])])
        return pd.DataFrame(joined_pairs(found), columns=["a", "b", "o"])

    dealt = sets.select("c", "n", "k", "s", "l").mapInArrow(tidy(deal), "r int, block binary")
    return dealt.groupBy("r").applyInPandas(tidy_group(meet), "a long, b long, o long")


def reaching(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the similarity.

    Histograms of both sets bound how many shingles they differ in; pairs too far apart end there. For the others
    the shorter set's shingles are looked up in the longer one by binary search.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for i in (4, 5))
            overlap = -(-percent * (na + nb) // (100 + percent))
            yield batch.select(["a", "b"]).filter(pa.array(np.abs(x - y).sum(axis=1) <= na + nb - 2 * overlap))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def joined(pairs: DataFrame, *names: str) -> DataFrame:
        left, right = (sets.select(F.col("c").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in names]) for side in "ab")
        pairs = pairs.select("a", "b")
        if small_enough(pairs, MOST_KEYS):  # pairs are different, so each side's rows meet by pair, however often one document stands in them
            found = left.join(F.broadcast(pairs), "a").join(right.join(F.broadcast(pairs), "b"), ["a", "b"])
        else:
            found = pairs.join(left, "a").join(right, "b")
        return found.select("a", "b", *[f"{x}_{side}" for x in names for side in "ab"])

    close = stage_table(joined(pairs, "n", "z").mapInArrow(tidy(near), "a long, b long"), "jaccard-near")
    return joined(close, "s").mapInArrow(tidy(probe), "a long, b long")


def join_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, long: int = LONG) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    return components(docs, k, percent, long).select("doc_id", "n_shingles", "component_id")


def components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, long: int = LONG) -> DataFrame:
    """Rows of docs as doc_id, n_shingles, f (name of the set), h (hash of the text), component, component_id.

    Two documents link when the Jaccard similarity of their sets of k-word shingles is at least percent.
    T-occurrence search in DivideSkip's manner: a document's shingles divide into those on short inverted lists
    and the rest. The short lists of its prefix are merged by a heap that skips; the documents that occur in
    them as often as the required overlap T leaves are candidates, and all other shingles are looked up in
    a candidate's set by binary search. Lists of more than `long` documents are not merged: their documents
    meet in lists of signatures (see signatures()), each made of several shingles, which are short where
    those of single shingles are long, and long for large groups of near copies alone.

    Documents of equal sets are one node, named by a 64-bit fingerprint, so copies cost one comparison. Only
    what can still join components is compared: first each node's best partner, by short lists and among the least
    members of its signature lists; then the pairs of short lists between different components; then, for some rounds, each node and the
    one node of another component that it meets most often when each signature list pairs neighbours of an order of its own; at
    last all members of different components that share a signature list. Components are carried from step to step.

    Null and empty texts have no shingles and link with nothing. Repeated rows share their class; a null
    doc_id never becomes a component's name unless its whole class has none. Empty input: no rows. Very long
    texts are one row's work, linear in their length. Columns beside doc_id and text are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    rows = stage_table(described(docs, k), "jaccard-rows")
    classes = rows.filter("n_shingles > 0").groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.min("h").alias("h"))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    bits = range_bits(total, 7)

    lists = stage_table(long_lists(docs, bits, k, long), "jaccard-long")
    least = long
    while not small_enough(lists.filter(F.col("df") > least), MOST_LONG):
        least *= 2
    common = np.array(sorted(r[0] for r in lists.filter(F.col("df") > least).select("t").toLocalIterator()), dtype=np.int64).astype(U)
    sent = spark.sparkContext.broadcast(common)

    met = stage_table(met_lists(docs, bits, k, percent, long, sent, least == long), "jaccard-met")
    pairs = stage_table(merged(met, bits, percent), "jaccard-pairs")
    hot = met.filter("w is null").select(F.explode(F.arrays_zip("cs", "ks")).alias("x")).groupBy(F.col("x.cs").alias("c")).agg(F.max("x.ks").alias("k"))
    hot = stage_table(hot, "jaccard-hot")
    nodes = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).union(hot.select("c")).distinct()
    wanted = nodes.join(classes.select(F.col("f").alias("c"), "h"), "c")
    sets = stage_table(picked_sets(docs, wanted, k), "jaccard-sets")

    common_sets = sets.join(F.broadcast(hot) if small_enough(hot, MOST_KEYS) else hot, "c")
    summed = lambda found: found.groupBy("a", "b").agg(F.sum("o").alias("o"))
    nearest = lambda found: found.groupBy("b").agg(F.max_by("a", F.struct("o", "a")).alias("a")).select("a", "b")
    signed = summed(signature_lists(common_sets.withColumn("l", F.col("c")), bits, percent, "stars"))
    links = reaching(stage_table(nearest(pairs).union(nearest(signed)).distinct(), "jaccard-best"), sets, percent)
    links = stage_table(links, "jaccard-links-0")
    labels = stage_table(connected_components(links, "a", "b", stage_table), "jaccard-labels-0")

    def labelled(df: DataFrame, column: str, name: str) -> DataFrame:
        named = labels.select(F.col("node").alias(column), F.col("component").alias(name))
        return join_small(df, named, column, "left", MOST_KEYS).withColumn(name, F.coalesce(name, column))

    apart, grown = not hot.isEmpty(), True
    for turn, mode in enumerate(["next"] * ROUNDS + ["all"]):
        if turn and (not apart or mode == "next" and not grown):
            continue
        rest = labelled(labelled(pairs.select("a", "b"), "a", "la"), "b", "lb").filter("la != lb").select("a", "b") if turn == 0 else None
        if apart:
            met_again = signature_lists(labelled(common_sets, "c", "l"), signature_bits(common_sets) if mode == "all" else bits, percent, mode, turn)
            if mode == "next":
                met_again = stage_table(summed(met_again), f"jaccard-apart-{turn}")
                apart = not met_again.isEmpty()
                both = met_again.union(met_again.select(F.col("b").alias("a"), F.col("a").alias("b"), "o")).filter("o > 0")
                met_again = nearest(both).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            rest = met_again.select("a", "b") if rest is None else rest.union(met_again.select("a", "b"))
        rest = stage_table(rest.distinct(), f"jaccard-rest-{turn}")
        grown = not rest.isEmpty()
        if grown:
            links = stage_table(reaching(rest, sets, percent), f"jaccard-links-{turn + 1}")
            grown = not links.isEmpty()
        if grown:
            links = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)
            labels = stage_table(connected_components(links, "a", "b", stage_table), f"jaccard-labels-{turn + 1}")

    known = classes.select("f", F.col("doc_id").alias("least")).join(labels.select(F.col("node").alias("f"), "component"), "f", "left")
    known = known.withColumn("component", F.coalesce("component", "f"))
    roots = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(roots, "component").select("f", "component", "component_id")
    out = rows.join(named, "f", "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """docs with one document of each component: the one of the least doc_id (null last), then of the least text hash; columns unchanged.

    Rows are told apart by doc_id and text hash together, so rows with a null or repeated id are kept or dropped by
    their own text. Rows equal in both are reduced to one. Documents without words stay, whatever their
    number. Only the keys of dropped rows move where they are few enough to send to all tasks.
    """
    found = stage_table(components(docs, **kw).filter("n_shingles > 0").select("doc_id", "h", "component"), "jaccard-components")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    kept = found.groupBy("component").agg(F.min(order).alias("kept"))
    dropped = found.join(kept, "component").filter(order != F.col("kept")).select("doc_id", "h").distinct()
    dropped = stage_table(dropped.select(F.col("doc_id").alias("id_x"), F.col("h").alias("h_x")), "jaccard-dropped")
    again = stage_table(found.groupBy("doc_id", "h").count().filter("count > 1").select(F.col("doc_id").alias("id_x"), F.col("h").alias("h_x")), "jaccard-repeated")
    rows = carried(docs, _id=F.col("doc_id"), _h=F.xxhash64("text"))

    def matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        small = F.broadcast(keys) if small_enough(keys, MOST_KEYS) else keys
        return rows.join(small, F.col("_id").eqNullSafe(F.col("id_x")) & (F.col("_h") == F.col("h_x")), how)

    rows = matched(rows, dropped, "left_anti")
    if not again.isEmpty():
        rows = matched(rows, again, "left_anti").unionByName(matched(rows, again, "left_semi").dropDuplicates(["_id", "_h"]))
    return rows.select(*returned(docs.columns))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by shared 4-word shingles, Jaccard similarity 0.85 or more. Edge cases: see components()."""
    return join_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
p AS (SELECT doc_id, unnest(s) AS g FROM s),
f AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM p a SEMI JOIN f ON a.g = f.g JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT n.doc_id, n_shingles, coalesce(min(r.c), n.doc_id) AS component_id FROM n LEFT JOIN r USING (doc_id) GROUP BY n.doc_id, n_shingles
"""
