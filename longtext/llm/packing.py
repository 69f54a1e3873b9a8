"""Best-fit packing with dual-feasible-function certificates and exchange between partitions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stage_table, table, tidy
from .tokens import balanced, token_ids, vocabulary_path

CAPACITY = 4096
END = 1
#: Pieces that one task packs together.
GROUP_ROWS = 2000
#: Rounds of exchange after the first packing, and the least gap of a sequence that takes part.
ROUNDS = 4
GAP = 16


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Token pieces of each document: (doc_id, piece, start, length, ids_crc32).

    Ids are those of tokens.token_ids, then `end`. Only the ids of one batch are held.
    """
    ship(docs.sparkSession)
    last = np.array([end], dtype="<u4")

    def cut(key, held: list, out: list) -> None:
        ids = np.concatenate([*held, last])
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((key, p, at, len(part), zlib.crc32(part)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or vocabulary_path()
        for batch in batches:
            keys, out, held = batch.column(0).to_pylist(), [], []
            n_rows = -1
            for rows, parts in balanced(batch.column(1)):
                for row, ids in zip(rows.tolist(), token_ids(parts, path), strict=True):
                    if row != n_rows and n_rows >= 0:
                        cut(keys[n_rows], held, out)
                        held = []
                    n_rows = row
                    held.append(ids)
            if n_rows >= 0:
                cut(keys[n_rows], held, out)
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "piece", "start", "length", "crc"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(tidy(encode), f"k {kind}, piece int, start long, length long, crc long")
    return made.select(F.col("k").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least number of bins, from dual feasible functions.

    For every threshold t up to half the capacity, the function that counts items over capacity - t as
    whole bins, drops items under t and keeps the rest is dual feasible; so is the rounding function
    that counts floor((k + 1) x / C) / k for x not a multiple of C / (k + 1). The best bound holds.
    """
    if not len(lengths):
        return 0
    many = np.bincount(lengths, minlength=capacity + 1)
    weight = np.concatenate([[0], np.cumsum(many * np.arange(capacity + 1))])
    count = np.concatenate([[0], np.cumsum(many)])
    t = np.arange(0, capacity // 2 + 1)
    large = count[capacity + 1] - count[capacity - t + 1]
    middle = weight[capacity - t + 1] - weight[t]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 21):
        x = lengths.astype(np.int64) * (k + 1)
        exact = x % capacity == 0
        best = max(best, int(-(-int(np.where(exact, lengths * k, (x // capacity) * capacity).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin. Bins of equal room form a stack; a bit set of rooms finds the tightest."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room_of, stacks, mask = [], [[] for _ in range(capacity + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        above = mask >> x
        if above:
            room = x + (above & -above).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(room_of), capacity
            room_of.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room_of[b] = room = room - x
        if room:
            stacks[room].append(b)
            mask |= 1 << room
    return bins, offsets, capacity - np.array(room_of, dtype=np.int64)


def group_packer(capacity: int, turn: int, final: bool):
    def pack_group(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        open_bins = np.zeros(len(fill), bool) if final else capacity - fill > GAP
        rows = rows.drop_columns(["_g"])
        rows = rows.append_column("sequence_id", pa.array((turn << 56) + (key[0].as_py() << 24) + bins, pa.int64()))
        rows = rows.append_column("offset", pa.array(offsets, pa.int64()))
        for name, value in (("group_bins", len(fill)), ("group_bound", lower_bound(lengths, capacity))):
            rows = rows.append_column(name, pa.array(np.full(len(bins), value), pa.int64()))
        return rows.append_column("_open", pa.array(open_bins[bins]))

    return pack_group


def pack(made: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id, offset, group_bins and group_bound to pieces (columns kept); every length is within 1..capacity.

    Full pieces are sequences of their own. The rest is dealt over groups of about group_rows, and each
    group is packed best-fit decreasing; group_bins is the number of its sequences and group_bound the number
    that its lower bound proves necessary, so equal numbers certify the group. Sequences without a notable gap
    close; the documents of those with gaps meet those of other groups in a new deal and are packed again,
    until one group holds them, a round closes hardly any, or the rounds end. Groups have a set size, so memory
    does not grow with the input.
    """
    names = made.columns
    full = made.filter(F.col("length") >= capacity)
    full = full.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *[F.lit(1).cast("long").alias(x) for x in ("group_bins", "group_bound")])
    rest = made.filter(F.col("length") < capacity)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    out, before = [full], None
    for turn in range(rounds + 1):
        n = rest.count()
        if not n:
            break
        groups = -(-n // group_rows)
        final = turn == rounds or groups == 1 or (before is not None and n > 0.9 * before)
        before = n

        dealt = rest.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)))
        packed = stage_table(
            dealt.groupBy("_g").applyInArrow(group_packer(capacity, turn, final), f"{schema}, sequence_id long, offset long, group_bins long, group_bound long, _open boolean"), f"pack-{turn}"
        )
        out.append(packed.filter(~F.col("_open")).drop("_open"))
        if final:
            break
        rest = packed.filter("_open").select(*names)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def pack_documents(docs: DataFrame, **kw) -> DataFrame:
    """Pieces of docs with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset, group_bins, group_bound.

    Null and empty texts are the end token alone. Repeated rows are packed as often as they occur.
    An empty table gives no rows; columns beside doc_id and text are not read.
    """
    return pack(stage_table(pieces(docs), "pieces"), **kw)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens. Edge cases: see pack_documents()."""
    return pack_documents(table(spark, sf_dir, "documents"))
