"""Benchmark decontamination with a broadcast hash set of test n-grams.

Method. Texts and test items are lower-cased (A-Z) and cut into words. Every run of ten
words of an item is a window; a shorter item is one window as a whole. The hashes of all
windows, with their words and items, are broadcast; a document's rolling windows are
looked up there, and each hit is verified on the words themselves before they count as
hit. Documents can then be dropped or the hit spans cut out of their texts.

Scale. One pass over the documents, without a shuffle. Long items are cut into
overlapping pieces by SQL functions, the set of all pieces is made by one task with
arrays and broadcast to the workers. It has a bound, ``MAX_BYTES`` of what a worker holds
(words, hashes, places and item numbers), counted before anything is gathered; a larger
benchmark is dealt by piece into parts within the bound, each part scanned on its own,
and the findings of a row are united by a keyed aggregation over rows with hits. Texts
are read from Arrow buffers in slices of a few megabytes, so memory is bounded whatever a
batch holds.

Defined results. A null text has no words. Items that are null, without words or without
id are ignored; rows of one item_id are one item. Repeated documents are rows of their
own. An empty benchmark hits nothing. Extra columns are kept, whatever their names; only
those named like the added ones are replaced.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.llm import rows, scratch, texts
from trellium.llm.scratch import store

WINDOW = 10
#: Bytes of a set: of its words, and of a window (hash 8, place 8, length 4, list of items 8 and 4, sieve up to 8).
MAX_BYTES = 64 << 20
ENTRY = 40
#: Windows of a piece of an item, and bytes of a chunk of the set on its way to the driver.
PIECE = 1 << 14
CHUNK = 4 << 20
ADDED = ("n_words", "n_hit", "items", "_spots")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
U = np.uint64


@dataclass
class Grams:
    """The windows of one length: sorted hashes, where their words stand, and the items that have each."""

    length: int
    hashes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    items: np.ndarray
    sieve: np.ndarray

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(at, k): the hashes that are in the set, and the first window that has each."""
        spot = hashes & U(8 * len(self.sieve) - 1)
        at = np.flatnonzero(self.sieve[(spot >> U(3)).astype(np.int64)] >> (spot & U(7)).astype(np.uint8) & 1)
        k = np.searchsorted(self.hashes, hashes[at])
        k[k == len(self.hashes)] = 0
        sure = self.hashes[k] == hashes[at]
        return at[sure], k[sure]


@dataclass
class GramSet:
    """Grams by length, the words of all pieces one after the other, and the names of the items."""

    grams: list[Grams]
    words: bytes
    names: list[str]

    def agrees(self, grams: Grams, k: int, said: bytes) -> int | None:
        """The window of these words, from the first of its hash on; None if there is none."""
        value = grams.hashes[k]
        while k < len(grams.hashes) and grams.hashes[k] == value:
            if self.words[grams.start[k] : grams.start[k] + grams.size[k]] == said:
                return k
            k += 1
        return None

    def pack(self) -> bytes:
        out = io.BytesIO()
        parts = {f"{k}{i}": getattr(g, k) for i, g in enumerate(self.grams) for k in ("hashes", "start", "size", "first", "items", "sieve")}
        names = np.frombuffer(json.dumps(self.names).encode(), np.uint8)
        np.savez(out, lengths=np.array([g.length for g in self.grams]), words=np.frombuffer(self.words, np.uint8), names=names, **parts)
        return out.getvalue()

    @staticmethod
    def unpack(raw: bytes) -> GramSet:
        held = np.load(io.BytesIO(raw))
        grams = [Grams(n, *(held[f"{k}{i}"] for k in ("hashes", "start", "size", "first", "items", "sieve"))) for i, n in enumerate(held["lengths"].tolist())]
        return GramSet(grams, held["words"].tobytes(), json.loads(held["names"].tobytes()))


def _item_words(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, length, words, bytes: runs of an item's words that hold all its windows, and what each costs in a set."""
    cut_up = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), _item_words(F.col("text")).alias("w"))
    some = cut_up.where(F.size("w") > 0).select("item", "w", F.least(F.size("w"), F.lit(window)).alias("length"))
    each = some.withColumn("s", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"), F.lit(PIECE))))
    part = each.select("item", "length", F.slice("w", F.col("s") + 1, F.lit(PIECE - 1) + F.col("length")).alias("w"))
    cost = F.octet_length("words") + F.lit(ENTRY) * (F.size("w") - F.col("length") + 1)
    return part.withColumn("words", F.array_join("w", " ")).select("item", "length", "words", cost.cast("long").alias("bytes"))


def gram_set(items: list[str], lengths: np.ndarray, words: pa.Array) -> GramSet:
    """The set of the pieces of items."""
    names = sorted(set(items))
    code_of = {n: i for i, n in enumerate(names)}
    codes = np.array([code_of[x] for x in items], np.int32)
    raw, offsets = texts.buffers(words)
    held = raw[offsets[0] : offsets[-1]].tobytes()
    offsets = offsets - offsets[0]
    hashes, where, bounds = texts.located_words(np.frombuffer(held, np.uint8), offsets, texts.ALNUM)
    stops = np.empty(len(where), np.int64)
    stops[:-1] = where[1:] - 1
    # texts stand one after the other without a space, so the last word of each ends at its end
    stops[bounds[1:] - 1] = offsets[1:]
    out = []
    for length in np.unique(lengths).tolist():
        grams = texts.gram_hashes(hashes, length)
        mine = np.flatnonzero(lengths == length)
        count = bounds[mine + 1] - bounds[mine] - length + 1
        at = np.repeat(bounds[mine] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        item = np.repeat(codes[mine], count)
        start, size = where[at], (stops[at + length - 1] - where[at]).astype(np.int32)
        order = np.lexsort((item, grams[at]))
        h, item, start, size = grams[at][order], item[order], start[order], size[order]
        text = lambda k: held[start[k] : start[k] + size[k]]  # noqa: B023, E731
        # windows of one hash are one window if their words agree, which all but never fails
        new = np.concatenate([[True], h[1:] != h[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        odd = {int(head[k]) for k in np.flatnonzero(~new).tolist() if text(k) != text(head[k])}
        if odd:
            tail = np.concatenate([np.flatnonzero(new)[1:], [len(h)]])
            for a in odd:
                b = int(tail[np.searchsorted(np.flatnonzero(new), a)])
                inner = sorted(range(a, b), key=lambda k: (text(k), int(item[k])))
                start[a:b], size[a:b], item[a:b] = start[inner], size[inner], item[inner]
                for k in range(a + 1, b):
                    new[k] = text(k) != text(k - 1)
        group = np.cumsum(new) - 1
        fresh = new.copy()
        fresh[1:] |= item[1:] != item[:-1]
        heads = np.flatnonzero(new)
        first = np.concatenate([[0], np.cumsum(np.bincount(group[fresh], minlength=len(heads)))])
        bits = max(16, len(heads).bit_length() + 5)
        sieve = np.zeros(1 << (bits - 3), np.uint8)
        spot = h[heads] & U((1 << bits) - 1)
        np.bitwise_or.at(sieve, (spot >> U(3)).astype(np.int64), np.left_shift(1, (spot & U(7)).astype(np.uint8)).astype(np.uint8))
        out.append(Grams(length, h[heads], start[heads], size[heads], first, item[fresh], sieve))
    return GramSet(out, held, names)


def _make_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    words = pa.concat_arrays([c.cast(pa.large_string()) for c in table.column("words").chunks])
    raw = gram_set(table.column("item").to_pylist(), table.column("length").to_numpy(), words).pack()
    for n, at in enumerate(range(0, len(raw), CHUNK)):
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([raw[at : at + CHUNK]], pa.binary())], names=["n", "chunk"])


def broadcast_set(part: DataFrame) -> Broadcast:
    """The set of the pieces in ``part``, whose bytes the caller has bounded; no bytes for none."""
    chunks = part.select("item", "length", "words").coalesce(1).mapInArrow(_make_set, "n int, chunk binary").collect()
    return part.sparkSession.sparkContext.broadcast(b"".join(bytes(r["chunk"]) for r in sorted(chunks, key=lambda r: r["n"])))


def _scan_slice(column: pa.Array, known: GramSet | None) -> tuple[list, list, list, list]:
    raw, offsets = texts.buffers(column)
    words, where, bounds = texts.located_words(raw, offsets, texts.ALNUM)
    n = len(column)
    counts = np.diff(bounds)
    step = np.zeros(len(words) + 1, np.int32)
    hits: dict[int, set[tuple[int, int]]] = {}
    buffer = memoryview(raw)
    for which, grams in enumerate(known.grams if known else ()):
        length = grams.length
        at, low = grams.look_up(texts.gram_hashes(words, length))
        owner = np.searchsorted(bounds, at, side="right") - 1
        inside = at + length <= bounds[owner + 1]
        for i, k, d in zip(at[inside].tolist(), low[inside].tolist(), owner[inside].tolist(), strict=True):
            stop = _WORD.match(buffer, int(where[i + length - 1]), int(offsets[d + 1])).end()
            said = b" ".join(_WORD.findall(buffer[int(where[i]) : stop])).lower()
            k = known.agrees(grams, k, said)
            if k is not None:
                step[i] += 1
                step[i + length] -= 1
                hits.setdefault(d, set()).add((which, k))
    hit = np.cumsum(step[:-1]) > 0
    before = np.concatenate([[0], np.cumsum(hit)])
    n_hit = before[bounds[1:]] - before[bounds[:-1]]
    spots = [np.flatnonzero(hit[bounds[d] : bounds[d + 1]]).tolist() if n_hit[d] else [] for d in range(n)]
    return counts.tolist(), n_hit.tolist(), [_names(known, hits.get(d, ())) for d in range(n)], spots


def _names(known: GramSet | None, hits) -> list[str]:
    if not hits:
        return []
    found = np.unique(np.concatenate([known.grams[w].items[known.grams[w].first[k] : known.grams[w].first[k + 1]] for w, k in hits]))
    return sorted(known.names[c] for c in found.tolist())


def _scanner(given: Broadcast, inside: int = -1, only_hits: bool = False):
    """Over batches of a column and a text, which may be field ``inside`` of that column: the column, with the findings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = GramSet.unpack(given.value) if given.value else None
        for batch in batches:
            said = batch.column(1) if inside < 0 else batch.column(0).field(inside)
            for a, b in texts.slices(said):
                n_words, n_hit, items, spots = _scan_slice(said.slice(a, b - a), known)
                columns = [
                    batch.column(0).slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array(items, pa.list_(pa.string())), pa.array(spots, pa.list_(pa.int32())),
                ]
                out = pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], *ADDED])
                yield out.filter(pa.array([x > 0 for x in n_hit], pa.bool_())) if only_hits else out

    return scan


def _row_key() -> Column:
    """256 bits, so that no two rows of different id or words share a key at any size."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    return F.sha2(F.concat(parts[0], F.lit("\x01"), parts[1]).cast("binary"), 256)


def _dealt(all_pieces: DataFrame, max_bytes: int) -> tuple[DataFrame, int]:
    """The pieces with ``part``, and the number of parts: no part beyond ``max_bytes``, unless by a single piece."""
    total, largest = all_pieces.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    parts = max(1, -(-total // max_bytes))
    while True:
        dealt = all_pieces.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(parts)))
        if parts == 1 or parts > 4 * total // max_bytes + 4:
            return dealt, parts
        heaviest = dealt.groupBy("part").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0]
        if heaviest <= max(max_bytes, largest):
            return dealt, parts
        parts += -(-parts // 4)


_FOUND = (("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"), ("_spots", "array<int>"))


@scratch.tidy
def _findings(docs: DataFrame, benchmark: DataFrame, max_bytes: int, replaced: tuple[str, ...]) -> DataFrame:
    """``row``, the columns of ``docs`` but those replaced, with ADDED."""
    dealt, parts = _dealt(pieces(benchmark), max_bytes)
    given = rows.carry(docs, replaced, said=F.col("text"))
    if parts == 1:
        kept = [c.lower() for c in rows.kept(docs, replaced)]
        inside = kept.index("text") if "text" in kept else -1
        given = given if inside < 0 else given.select("row")
        return given.mapInArrow(_scanner(broadcast_set(dealt), inside), rows.schema(given.select("row"), *_FOUND))
    held = store(dealt, "pieces")
    keyed = docs.select(_row_key().alias("key"), F.col("text").alias("said"))
    hits = []
    for part in range(parts):
        known = broadcast_set(held.df.where(F.col("part") == part))
        found = keyed.mapInArrow(_scanner(known, only_hits=True), rows.schema(keyed.select("key"), *_FOUND))
        hits.append(store(found.select("key", "items", "_spots"), "contamination"))
        known.destroy()
    held.drop()
    every = hits[0].df
    for more in hits[1:]:
        every = every.unionByName(more.df)
    united = store(
        every.groupBy("key").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_spots")))).alias("_spots"),
        ), "contamination"
    )
    for old in hits:
        old.drop()
    counted = F.coalesce(F.size(_item_words(F.coalesce("text", F.lit("")))), F.lit(0)).cast("long")
    marked = rows.carry(docs, replaced, key=_row_key(), n_words=counted).join(united.df, "key", "left")
    none = {"items": "array<string>", "_spots": "array<int>"}
    filled = marked.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in none.items()})
    return filled.select("row", "n_words", F.size("_spots").cast("long").alias("n_hit"), *none)


def scan(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_BYTES, keep_text: bool = False) -> DataFrame:
    """``docs``, without text unless it is kept, with n_words, n_hit, items and ``_spots``, the numbers of the words that are hit."""
    replaced = ADDED if keep_text else (*ADDED, "text")
    return _findings(docs, benchmark, max_bytes, replaced).select(*rows.restore(rows.kept(docs, replaced)), *ADDED)


def cut(text: str | None, spots: list[int]) -> str | None:
    """The text without its hit words; a run of them goes with what stands inside it."""
    if text is None or not len(spots):
        return text
    raw = text.encode()
    gone, out, last, run = set(spots), [], 0, None
    for i, m in enumerate(_WORD.finditer(raw)):
        if i in gone:
            run = (run[0] if run else m.start(), m.end())
        elif run:
            out.append(raw[last : run[0]])
            last, run = run[1], None
    if run:
        out.append(raw[last : run[0]])
        last = run[1]
    out.append(raw[last:])
    return b"".join(out).decode()


def remove(docs: DataFrame, benchmark: DataFrame, spans: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The columns of ``docs``: without contaminated documents, or with their spans cut out."""
    found = _findings(docs, benchmark, max_bytes, ())
    if not spans:
        return found.where("n_hit = 0").select(*rows.restore(docs.columns))
    text = F.col("row.text")
    clean: Column = F.udf(cut, "string", useArrow=True)(text, F.col("_spots"))
    kept = F.when(F.col("n_hit") > 0, clean).otherwise(text)
    return found.select(*[kept.alias(c) if c.lower() == "text" else rows.restore([c])[0] for c in docs.columns])
