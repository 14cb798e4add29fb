"""Best-fit packing of token sequences, by hierarchical residual packing.

Method. Items are dealt evenly to leaves of a tree. A leaf packs its items best-fit, the
longest first. Full bins are done; bins with room rise to the parent, which packs the bins
of its children best-fit as if they were items, and so on to the root. Best-fit leaves at
most one bin of half the capacity or less per task, and two larger ones never merge, so
what can still change above a task is that bin and, of bins equally full, no more than
there are tasks below its parent: the others are done as well.

Scale. What is packed are lengths, in Arrow batches. A leaf holds ``LEAF`` rows or
``LEAF_BYTES`` at a time; it passes on at most ``OPEN`` bins of each fill, so a task above
holds a bounded number as well, and the tree's depth is a logarithm of the rows. Every
level is written in the shared folder. Every bin that moves is the one small bin of its
task, so the moves are fewer than the tasks; they are broadcast while those are at most
``BROADCAST``, and joined beyond.

Texts become tokens in one pass. What a worker holds is a batch, a bounded cache of
pieces of words, and one text's tokens; texts of any length are cut between words where
tokens always end.

Defined results. A null text is an empty one, which is the end token alone. Documents over
the capacity are cut so that only the first piece may be shorter. Items without a length,
or with one outside 1 to the capacity, get null places. Repeated rows are items of their
own. Empty tables give no rows. Extra columns are kept, whatever their names; only those
named like the added ones, and ``text`` where it becomes tokens, are replaced.
"""

from __future__ import annotations

import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm import rows, scratch
from trellium.llm.scratch import store

CAPACITY = 1024
END = 2
LEAF, LEAF_BYTES, LEAST_LEAF = 1 << 17, 64 << 20, 1 << 13
FAN, OPEN = 16, 32
BROADCAST = 1_000_000
CACHE = 250_000
TEXT_PIECE, OUT_BYTES = 1 << 20, 16 << 20
#: A space that always starts a token.
BETWEEN = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
PIECES = ("piece", "start", "length", "tokens")
PLACES = ("sequence_id", "offset")


def _classes() -> tuple[str, str]:
    """All letters and all numbers of Unicode, as what stands between the brackets of a pattern."""
    found: dict[str, list[list[int]]] = {"L": [], "N": []}
    for code in range(sys.maxunicode + 1):
        ranges = found.get(unicodedata.category(chr(code))[0])
        if ranges is not None:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) for ranges in found.values())
    return letters, numbers


def word_pattern() -> re.Pattern:
    """What byte-level vocabularies split texts at: contractions, words, numbers and marks with the space ahead, and spaces.

    The first and the marked alternatives take what is ASCII or Latin-1 and followed by that, which is most of a
    text, without a look at the large classes; the others say the same of all of Unicode.
    """
    letters, numbers = _classes()
    space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    latin, near = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"(?=[\x00-\x7f]|\Z)"
    quick = rf" ?[{latin}]++(?=[\x00-\xff]|\Z)"
    short = r"'s|'t|'re|'ve|'m|'ll|'d"
    ascii_only = rf" ?[0-9]++{near}| ?[\x00-\x08\x0e-\x1f!-/:-@\[-`{{-\x7f]++{near}"
    return re.compile(rf"{quick}|{short}|{ascii_only}| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


class Encoder(dict):
    """Token ids, as little-endian unsigned 32-bit numbers, of pieces of words seen before, up to a bound; of texts by ``encode``."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.pattern = word_pattern()
        marks = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, marks)) or r"(?!)")
        # the file's own vocabulary, whose ids are the ranks of its merges
        byte = {c: bytes([b]) for b, c in self._letters().items()}
        ranks = {b"".join(byte[c] for c in token): i for token, i in self.whole.get_vocab().items() if token not in marks}
        self.merged = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _letters() -> dict[int, str]:
        """The letter that stands for each byte: itself where it is visible Latin-1, else the next free one from U+0100 on."""
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in seen]
        return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self.merged.encode_ordinary(piece)
        value = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return value

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = BETWEEN.search(text, at + TEXT_PIECE) if len(text) > at + TEXT_PIECE else None
            end = cut.start() if cut else len(text)
            part = text[at:end]
            if self.special.search(part):
                ids = self.whole.encode(part, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out += map(self.__getitem__, self.pattern.findall(part))
            at = end
        return b"".join(out)


def _cutter(path: str, capacity: int, end: int):
    """Batches of row and text to batches of row and PIECES."""
    last = struct.pack("<I", end)

    def batch_of(row: pa.Array, out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        at, piece, start, tokens = zip(*out, strict=True)
        arrays = [
            row.take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
            pa.array([len(t) // 4 for t in tokens], pa.int64()), pa.array(tokens, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["row", *PIECES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            out: list[tuple[int, int, int, bytes]] = []
            held = 0
            for i, text in enumerate(batch.column(1)):
                tokens = encoder.encode(text.as_py() or "") + last
                total = len(tokens) // 4
                starts = range(total % capacity or capacity, total, capacity)
                for piece, (a, b) in enumerate(zip([0, *starts], [*starts, total], strict=True)):
                    out.append((i, piece, a, tokens[4 * a : 4 * b]))
                held += len(tokens)
                if held >= OUT_BYTES:
                    yield batch_of(batch.column(0), out)
                    out, held = [], 0
            if out:
                yield batch_of(batch.column(0), out)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The columns of ``docs`` but text, per piece of at most ``capacity`` tokens, with PIECES; ``tokens`` are little-endian unsigned 32-bit ids.

    ``tokenizer`` is the path, on the workers, of a byte-level vocabulary.
    """
    replaced = ("text", *PIECES)
    given = rows.carry(docs, replaced, text=F.col("text"))
    types = (("piece", "int"), ("start", "long"), ("length", "long"), ("tokens", "binary"))
    cut = given.mapInArrow(_cutter(tokenizer, capacity, end), rows.schema(given.select("row"), *types))
    return cut.select(*rows.restore(rows.kept(docs, replaced)), *PIECES)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """The bin and the offset of every item, and how full each bin is: the longest first, each into the fullest bin that has room."""
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room for r
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        size = lengths[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, fills


def _rising(fills: list[int], capacity: int) -> list[bool]:
    """Of the bins with room, at most OPEN of each fill."""
    counts = [0] * (capacity + 1)
    out = []
    for fill in fills:
        counts[fill] += 1
        out.append(fill < capacity and counts[fill] <= OPEN)
    return out


def _leaf(capacity: int):
    """Batches of row and length, leaf by leaf, to row, bin, at, and at the first item of each bin that rises its fill."""

    def packed(batches: list[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
        lengths = pa.chunked_array([b.column(1) for b in batches]).to_pylist()
        sound = [i for i, n in enumerate(lengths) if n is not None and 1 <= n <= capacity]
        bins, offsets, fills = best_fit([lengths[i] for i in sound], capacity)
        rising = _rising(fills, capacity)
        bin_of: list[int | None] = [None] * len(lengths)
        at: list[int | None] = [None] * len(lengths)
        fill: list[int | None] = [None] * len(lengths)
        for i, b, offset in zip(sound, bins, offsets, strict=True):
            bin_of[i], at[i] = first + b, offset
            if offset == 0 and rising[b]:
                fill[i] = fills[b]
        a = 0
        for batch in batches:
            z = a + batch.num_rows
            columns = [batch.column(0), pa.array(bin_of[a:z], pa.int64()), pa.array(at[a:z], pa.int64()), pa.array(fill[a:z], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "bin", "at", "fill"])
            a = z

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = TaskContext.get().partitionId() << 20
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, batch.num_rows, LEAF):
                part = batch.slice(a, LEAF)
                if held and (sum(b.num_rows for b in held) + part.num_rows > LEAF or sum(b.nbytes for b in held) > LEAF_BYTES):
                    yield from packed(held, leaf * LEAF)
                    held, leaf = [], leaf + 1
                held.append(part)
        if held:
            yield from packed(held, leaf * LEAF)

    return run


def _merge(capacity: int):
    """The bins of a group, packed as items: those that move, with where to, and those that rise."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        names = frame["bin"].tolist()
        bins, offsets, fills = best_fit(frame["fill"].tolist(), capacity)
        host = {b: name for name, b, offset in zip(names, bins, offsets, strict=True) if offset == 0}
        moved = [(name, host[b], offset, None) for name, b, offset in zip(names, bins, offsets, strict=True) if offset]
        risen = [(host[b], None, None, fill) for b, (fill, up) in enumerate(zip(fills, _rising(fills, capacity), strict=True)) if up]
        out = pd.DataFrame(moved + risen, columns=["bin", "into", "shift", "fill"]).astype({"bin": "int64", "into": "Int64", "shift": "Int64", "fill": "Int32"})
        return out.assign(leaf=int(key[0]))

    return run


def _resolved(levels: list[DataFrame]) -> DataFrame:
    """bin, into, shift: where each moved bin ends up."""
    known = levels[-1]
    for moves in reversed(levels[:-1]):
        further = known.select(F.col("bin").alias("into"), F.col("into").alias("host"), F.col("shift").alias("more"))
        through = moves.join(further, "into", "left").select("bin", F.coalesce("host", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        known = known.unionByName(through)
    return known


@scratch.tidy
def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length", fan: int = FAN, leaf: int = LEAF, least: int = LEAST_LEAF) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``, gapless from 0, in sequences of at most ``capacity``."""
    spark = items.sparkSession
    held = store(rows.carry(items, PLACES, length=rows.named(length).cast("long")), "items")
    count = held.df.count()
    tasks = max(1, -(-count // leaf), min(spark.sparkContext.defaultParallelism, -(-count // least)))
    types = (("bin", "long"), ("at", "long"), ("fill", "int"))
    placed = store(held.df.repartition(tasks).mapInArrow(_leaf(capacity), rows.schema(held.df.select("row"), *types)), "bins")
    held.drop()
    rising = placed.df.where("fill is not null").select("bin", "fill", F.shiftright("bin", LEAF.bit_length() - 1).alias("leaf"))
    leaves = rising.select("leaf").distinct().count()
    bound, levels = leaves, []
    while leaves > 1:
        leaves = -(-leaves // fan)
        dealt = rising.withColumn("leaf", F.pmod(F.xxhash64("leaf"), F.lit(leaves)))
        level = store(dealt.groupBy("leaf").applyInPandas(_merge(capacity), "bin long, into long, shift long, fill int, leaf long"), "level")
        levels.append(level.df.where("into is not null").select("bin", "into", "shift"))
        rising = level.df.where("into is null").select("bin", "fill", "leaf")
    found = placed.df.select("row", "bin", "at")
    if levels:
        moves = _resolved(levels).withColumnRenamed("bin", "moved")
        found = found.join(F.broadcast(moves) if bound <= BROADCAST else moves, F.col("bin") == F.col("moved"), "left")
        found = found.select("row", F.coalesce("into", "bin").alias("bin"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"))
    return found.select(*rows.restore(rows.kept(items, PLACES)), F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id, tokens: the tokens of packed pieces, sequence by sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "tokens")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, part: F.concat(all_, part["tokens"]))
    return packed.where("sequence_id is not null").groupBy("sequence_id").agg(joined.alias("tokens"))
