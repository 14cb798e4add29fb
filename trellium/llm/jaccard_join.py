"""Exact n-gram Jaccard self-join, size-aware: subsets for light sets, inverted lists for heavy ones.

Method. A document's set is its distinct word shingles; documents of equal sets form a
class, and only classes are joined. Two linked sets of sizes a <= b share at least
c(b) = ceil(t * b) shingles, so

* a light set (up to ``boundary`` shingles) enumerates all its subsets of the fixed sizes
  c(b) of its possible partners: linked sets share one;
* a heavy set is entered in inverted lists. Sizes are cut into bands, and in each band the universe of shingles is dealt by hash into more
  segments than linked sets can have differences: by the pigeonhole principle they agree
  on a segment, and the list of that segment's content holds both. A set stands in the
  lists of its own band and, if it can have partners there, of the next. Lists of single shingles would be as long as a
  shared passage is common; segments hold about six shingles, so only near copies meet.

The boundary is where enumerating costs as much as the lists (``light_boundary``).

Segments outnumber the possible differences by some spare ones, so linked sets agree on as
many segments, and each set may leave the lists that are longest, one fewer than it has to
spare: in any fixed order of all lists, linked sets still share the first list they have
in common. That clears the lists of segments that hold a shared passage alone.

Every pair that shares a key is in the group of that list's smallest class. Members are
compared on parity sketches first: the bits in which the sketches of two sets differ are
at most as many as their differences, so a pair with too many is no link, for certain.
In the first round a group is cut into blocks, each with the group's panel of some
``PANEL`` members beside it, and a spanning forest of the pairs that remain in a block is
verified on the full sets: the panel ties the blocks of a family together at a cost in
proportion to its size. Where members of a group are still not connected by verified
links, the later rounds take the members outside the group's largest component, against
each other and against all the rest, by pairs of blocks, and verify the likeliest pairs
between each two components, more each round, until none is left out. All pairs that
could still change a component are verified, but the pairs within a family of copies are
never expanded.

``join(..., count=True)`` counts every link as well. Linked sets are in one component, so the
classes of each component are cut into blocks, and in each pair of blocks all pairs that the
sketches leave are verified on the full sets. A pair of blocks returns degrees, not pairs.

Scale. What is shuffled are 64-bit keys, about a third as many as shingles, once, then the
entries of lists that are shared, and the (group, class) pairs with sketches of four bits a shingle, and the full
sets of classes that have a pair left. A list holds at most one entry a class and a set
spreads over as many lists as it has segments, so a family that a third of the documents
belong to is spread over many tasks. No list or group is gathered in one task beyond two
blocks of ``BLOCK`` sketches. What one component, group or class has is joined from
written tables, so that adaptive execution splits a hot one. Whole texts are used.

Classes are told apart by 128 bits: their numbers have 64, and the few sets whose numbers
would agree (rows squared over 2^65 are expected) get other ones before anything is
joined. Rows are told apart by the MD5 of doc_id and text.

Defined results. A text that is null or has no words has an empty set and links with
nothing. Rows of equal sets, repeated rows among them, are linked. doc_id is of any
orderable type; a null one takes part in links and is never the smallest of its component
unless all are null. Empty tables give empty results. ``keep_one`` keeps extra columns,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellium.llm import bloom, rows, scratch, texts
from trellium.llm.components import connected_components, extended
from trellium.llm.scratch import Stored, store

U = np.uint64
BLOCK = 512
#: Members of a group that stand beside each of its blocks in the first round.
PANEL = 64
#: Bits of a sketch per shingle, and pairs verified between two components by round.
SKETCH = 4
ROUNDS = (4, 64, 1024, 1 << 40)
#: What reading a list and verifying what it brings is worth, in keys.
LIST_COST = 48
MAX_LIGHT = 24
#: Wider bands have more segments, but fewer sets that also stand in the next one.
BAND = 1.6
MAX_BITS = 1 << 23
#: Shingles that a product of memberships takes at a time, and its multiplications worth one pair's comparison.
COLUMNS = 4096
PAIR_COST = 100_000


@dataclass(frozen=True)
class Rule:
    """Shingles of ``n`` words; linked at intersection / union >= ``num`` / ``den``."""

    n: int = 5
    num: int = 80
    den: int = 100

    def partner(self, a: int) -> int:
        """The largest size of a set that can link with one of size a."""
        return a * self.den // self.num

    def common(self, b: int) -> int:
        """Shingles shared at least with a partner that is not larger."""
        return -(-self.num * b // self.den)

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)


def subset_sizes(rule: Rule, a: int) -> list[int]:
    """The sizes of subsets that a light set of size a enumerates."""
    sizes = {rule.common(b) for b in range(a, rule.partner(a) + 1)}
    return sorted(sizes - ({a} if rule.partner(a) == a else set()))


def bands(rule: Rule, first: int, upto: int) -> list[tuple[int, int, int]]:
    """(largest size, segments, spare segments) of the bands of heavy sets from ``first`` on."""
    out, low = [], first
    while True:
        top = max(rule.partner(low), int(BAND * low))
        apart = (rule.den - rule.num) * 2 * top // (rule.den + rule.num)
        spare = 1 + apart // 4
        out.append((top, apart + spare, spare))
        if top >= upto:
            return out
        low = top + 1


def light_boundary(rule: Rule) -> int:
    """The largest size up to which enumerating subsets costs no more than the lists."""
    x = 0
    while x < MAX_LIGHT:
        a = x + 1
        subsets = sum(comb(a, c) for c in subset_sizes(rule, a))
        (_, own, _), *rest = bands(rule, a, rule.partner(a) + 1)
        if subsets > own + (rest[0][1] if rest else 0) + LIST_COST:
            break
        x = a
    return x


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, and n + 1 offsets into them."""
    raw, offsets = texts.buffers(column)
    words, bounds = texts.word_hashes(raw, offsets, texts.SPACED)
    grams = texts.gram_hashes(words, n)
    parts, sizes = [], np.zeros(len(column) + 1, np.int64)
    for d in range(len(column)):
        a, b = int(bounds[d]), int(bounds[d + 1])
        if b - a >= n:
            part = np.unique(grams[a : b - n + 1])
        elif b > a:
            part = texts.gram_hashes(words[a:b], b - a) ^ U(b - a)
        else:
            continue
        parts.append(part)
        sizes[d + 1] = len(part)
    return (np.concatenate(parts) if parts else np.empty(0, U)), np.cumsum(sizes)


def signatures(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; of an empty one too, which the caller leaves out."""

    def one(salt: int) -> np.ndarray:
        total = np.concatenate([np.zeros(1, U), np.cumsum(texts.mix(tokens ^ U(salt)), dtype=U)])
        return texts.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(U))

    return one(0x5851F42D4C957F2D), one(0x9FB21C651E98DF25)


def class_numbers(tokens: np.ndarray, bounds: np.ndarray, clashes: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each set's class, and a second hash; numbers in ``clashes`` give way to other ones."""
    first, second = signatures(tokens, bounds)
    number = first.view(np.int64)
    if clashes:
        number = np.where(np.isin(number, list(clashes)), texts.mix(first ^ texts.mix(second)).view(np.int64), number)
    return number, second.view(np.int64)


def keys(tokens: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the set, code) of all entries of the sets, light and heavy.

    The code is 4 times the lists that the set may leave plus the kind of the entry:
    own band, next band, or subset. Segments that are empty are entered only by sets with
    as many as they have to spare; otherwise they count among the lists left.
    """
    sizes, x = np.diff(bounds), light_boundary(rule)
    out_key, out_set, out_code = [np.empty(0, U)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    mixed = texts.mix(tokens)
    for a in np.unique(sizes[(sizes > 0) & (sizes <= x)]).tolist():
        rows = np.flatnonzero(sizes == a)
        values = mixed[bounds[rows][:, None] + np.arange(a)]
        for c in subset_sizes(rule, a):
            chosen = np.array(list(combinations(range(a), c)), np.int64)
            sums = values[:, chosen].sum(axis=2, dtype=U)
            out_key.append(texts.mix(sums + U(c)).ravel())
            out_set.append(np.repeat(rows, len(chosen)))
            out_code.append(np.full(len(rows) * len(chosen), 2, np.int32))
    if not len(sizes) or int(sizes.max()) == 0:
        return out_key[0], out_set[0], out_code[0]
    table = bands(rule, x + 1, rule.partner(int(sizes.max())) + 1)
    tops = np.array([t for t, _, _ in table])
    own = np.searchsorted(tops, sizes)
    for shift in (0, 1):
        if shift == 0:
            rows, band = np.flatnonzero(sizes > x), own[sizes > x]
        else:
            reach = np.searchsorted(tops, sizes * rule.den // rule.num)
            light = sizes <= x
            rows = np.flatnonzero((sizes > 0) & (light & (sizes * rule.den // rule.num > x) | ~light & (reach > own)))
            band = np.where(light[rows], 0, own[rows] + 1)
        if not len(rows):
            continue
        segments = np.array([s for _, s, _ in table], np.int64)[band]
        spare = np.array([g for _, _, g in table], np.int64)[band]
        start = np.concatenate([[0], np.cumsum(segments)])
        length = sizes[rows]
        owner = np.repeat(np.arange(len(rows)), length)
        at = np.arange(int(length.sum())) - np.repeat(np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        token = tokens[bounds[rows][owner] + at]
        salt = texts.mix(band.astype(U))
        dealt = texts.mix(token ^ salt[owner])
        slot = start[owner] + (dealt % segments[owner].astype(U)).astype(np.int64)
        sums, full = np.zeros(int(start[-1]), U), np.bincount(slot, minlength=int(start[-1])) > 0
        np.add.at(sums, slot, texts.mix(dealt))
        whose = np.repeat(np.arange(len(rows)), segments)
        place = np.arange(int(start[-1])) - start[whose]
        empty = segments - np.bincount(whose[full], minlength=len(rows))
        stay = full | (empty >= spare)[whose]
        key = texts.mix(sums + texts.mix((band[whose].astype(U) << U(40)) + place.astype(U)))
        code = 4 * np.maximum(spare - 1 - empty, 0) * (empty < spare) + shift
        out_key.append(key[stay])
        out_set.append(rows[whose[stay]])
        out_code.append(code[whose[stay]].astype(np.int32))
    return np.concatenate(out_key), np.concatenate(out_set), np.concatenate(out_code)


def _digest(rule: Rule, clashes: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in texts.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                tokens, bounds = shingle_sets(part.column(2), rule.n)
                sizes = np.diff(bounds)
                number, second = class_numbers(tokens, bounds, clashes)
                held = pa.array(sketches(tokens, bounds), pa.binary())
                empty = sizes == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes), pa.array(number, mask=empty), pa.array(second, mask=empty), held],
                    names=["doc_id", "k", "n", "v", "w", "sketch"],
                )

    return run


def _entries(rule: Rule, clashes: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in texts.slices(batch.column(0)):
                tokens, bounds = shingle_sets(batch.column(0).slice(a, b - a), rule.n)
                number, _ = class_numbers(tokens, bounds, clashes)
                if len(seen) > 100_000:
                    seen.clear()
                new = [d for d, s in enumerate(number.tolist()) if bounds[d] < bounds[d + 1] and not (s in seen or seen.add(s))]
                if not new:
                    continue
                sizes = np.diff(bounds)[new]
                picked = np.concatenate([tokens[bounds[d] : bounds[d + 1]] for d in new])
                key, owner, code = keys(picked, np.concatenate([[0], np.cumsum(sizes)]), rule)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(number[new][owner]), pa.array(code)], names=["key", "v", "code"]
                )

    return run


def _sets(rule: Rule, clashes: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in texts.slices(batch.column(0)):
                tokens, bounds = shingle_sets(batch.column(0).slice(a, b - a), rule.n)
                held = [tokens[bounds[d] : bounds[d + 1]].tobytes() for d in range(b - a)]
                number, _ = class_numbers(tokens, bounds, clashes)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(held, pa.binary())], names=["v", "tokens"])

    return run


def sketches(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Of each set the parities of its shingles in at least SKETCH bits a shingle, a power of two."""
    sizes = np.diff(bounds)
    words = 1 << np.ceil(np.log2(np.maximum(sizes * SKETCH / 64, 1))).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(words)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spot = texts.mix(tokens ^ U(0x2545F4914F6CDD1D))
    at = start[owner] + ((spot >> U(6)) & (words[owner] - 1).astype(U)).astype(np.int64)
    out = np.zeros(int(start[-1]), U)
    np.bitwise_xor.at(out, at, U(1) << (spot & U(63)))
    return [out[a:b].tobytes() for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def _apart(rule: Rule, held: list[bytes], sizes: np.ndarray, side: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing bits) of the pairs that may be links, of different sides and components."""
    words = min(len(x) for x in held) // 8
    table = np.array([np.bitwise_xor.reduce(np.frombuffer(x, U).reshape(-1, words), axis=0) for x in held])
    mixed = bool((side != side[0]).any())
    out = []
    for i in range(1, len(held)):
        both = sizes[:i] + sizes[i]
        most = both - 2 * (-(-rule.num * both // (rule.num + rule.den)))
        fits = np.minimum(sizes[:i], sizes[i]) * rule.den >= np.maximum(sizes[:i], sizes[i]) * rule.num
        fits &= comp[:i] != comp[i]
        if mixed:
            fits &= side[:i] != side[i]
        at = np.flatnonzero(fits)
        if len(at):
            bits = np.bitwise_count(table[at] ^ table[i]).sum(axis=1).astype(np.int64)
            near = bits <= most[at]
            out.append((np.full(int(near.sum()), i), at[near], bits[near]))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(n: int, i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, likeliest first."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k in np.lexsort((j, i, bits)).tolist():
        a, b = root(int(i[k])), root(int(j[k]))
        if a != b:
            up[a] = b
            out.append((int(i[k]), int(j[k])))
    return out


def _likeliest(comp: np.ndarray, i: np.ndarray, j: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
    """The pairs to verify, up to ``most`` between two components, and whether that left any out."""
    low, high = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
    order = np.lexsort((j, i, bits, high, low))
    new = np.ones(len(order), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    kept = np.arange(len(order)) - first < most
    return order[kept], not bool(kept.all())


def _candidates(rule: Rule, most: int):
    """Over rows sorted by group (r, i, j): pairs u, v to verify; ``most`` 0 asks for forests.

    A row of u = v tells that pairs were left out. Groups are no larger than two blocks.
    """

    def of_group(v, n, side, comp, held) -> Iterator[tuple[int, int]]:
        v, first = np.unique(v, return_index=True)
        if len(v) < 2:
            return
        n, side, comp = n[first], side[first], comp[first]
        held = [held[x] for x in first.tolist()]
        i, j, bits = _apart(rule, held, n, side, comp)
        if not len(i):
            return
        if most == 0:
            for a, b in _forest(len(v), i, j, bits):
                yield int(v[a]), int(v[b])
            return
        chosen, left_out = _likeliest(comp, i, j, bits, most)
        for k in chosen.tolist():
            yield int(v[i[k]]), int(v[j[k]])
        if left_out:
            yield int(v[0]), int(v[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            waiting = now if waiting is None else pa.concat_tables([waiting, now])
            yield from groups(waiting, False)
            waiting = rest(waiting)
        if waiting is not None and waiting.num_rows:
            yield from groups(waiting, True)

    def edges_of(table: pa.Table) -> np.ndarray:
        r, i, j = (table.column(c).to_numpy() for c in ("r", "i", "j"))
        return np.flatnonzero((r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1

    def rest(table: pa.Table) -> pa.Table:
        ends = edges_of(table)
        return table.slice(int(ends[-1])) if len(ends) else table

    def groups(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        ends = edges_of(table).tolist()
        stops = ends + ([table.num_rows] if last else [])
        if not stops:
            return
        v, n, side, comp = (table.column(c).to_numpy() for c in ("v", "n", "b", "comp"))
        held = table.column("sketch").to_pylist()
        found: list[tuple[int, int]] = []
        for a, b in zip([0, *stops], stops, strict=False):
            found.extend(of_group(v[a:b], n[a:b], side[a:b], comp[a:b], held[a:b]))
        if found:
            u, w = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64())], names=["u", "v"])

    return run


def _verified(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_py(), U), np.frombuffer(b.as_py(), U)
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                keep.append(rule.linked(int((large[at] == small).sum()), len(a), len(b)))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["u", "v"])

    return run


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair share."""
    ids, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1
    width = int((often > 1).sum())
    if width * len(sets) ** 2 > PAIR_COST * len(i):
        both = np.empty(len(i), np.int64)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            small, large = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both[k] = int((large[at] == small).sum())
        return both
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    kept = often[inverse] > 1
    owner, column = owner[kept], place[inverse[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    # counts stay below 2 ** 24, where single precision is exact
    total = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(sets), min(COLUMNS, width - start)), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        total += dense @ dense.T
    return total[i, j].astype(np.int64)


def _degrees(rule: Rule):
    """Over rows sorted by component and pair of blocks (r, i, j): v and the rows of the classes linked with it."""

    def of_group(v, side, m, held) -> Iterator[tuple[int, int]]:
        if len(v) < 2:
            return
        sets = [np.frombuffer(x, U) for x in held]
        sizes = np.array([len(x) for x in sets])
        drawn = sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
        i, j, _ = _apart(rule, drawn, sizes, side, np.arange(len(v)))
        if not len(i):
            return
        both = _common(sets, i, j)
        linked = rule.den * both >= rule.num * (sizes[i] + sizes[j] - both)
        degree = np.zeros(len(v), np.int64)
        np.add.at(degree, i[linked], m[j[linked]])
        np.add.at(degree, j[linked], m[i[linked]])
        at = np.flatnonzero(degree)
        yield from zip(v[at].tolist(), degree[at].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        group = None

        def done() -> Iterator[pa.RecordBatch]:
            v, side, m, held = zip(*waiting, strict=True)
            found = list(of_group(np.array(v), np.array(side), np.array(m), list(held)))
            if found:
                u, d = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(d, pa.int64())], names=["v", "degree"])

        for batch in batches:
            r, i, j, side, v, m, held = (c.to_pylist() for c in batch.columns)
            for k, key in enumerate(zip(r, i, j, strict=True)):
                if key != group:
                    if waiting:
                        yield from done()
                    waiting.clear()
                    group = key
                waiting.append((v[k], side[k], m[k], held[k]))
        if waiting:
            yield from done()

    return run


def row_key():
    """128 bits that tell rows of different doc_id or text apart."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat(parts[0], F.lit("\x01"), parts[1]).cast("binary")))


def digests(docs: DataFrame, rule: Rule) -> tuple[Stored, frozenset[int]]:
    """doc_id, k, n, v, w, sketch of every row, and the clashes that were resolved for classes to have numbers of their own.

    What reaches the driver are the numbers that two different sets share, about the
    square of the rows over 2^65.
    """
    given = docs.select("doc_id", row_key().alias("k"), "text")
    schema = rows.schema(given.select("doc_id", "k"), ("n", "long"), ("v", "long"), ("w", "long"), ("sketch", "binary"))
    clashes: frozenset[int] = frozenset()
    while True:
        base = store(given.mapInArrow(_digest(rule, clashes), schema), "digests")
        per = base.df.where("v is not null").groupBy("v").agg(F.min("w").alias("low"), F.max("w").alias("high"))
        found = {r["v"] for r in per.where("low <> high").select("v").collect()}
        if found <= clashes:
            return base, clashes
        clashes |= found
        base.drop()


def _members(docs: DataFrame, rule: Rule, clashes: frozenset[int]) -> Stored:
    """r, v: the classes of each group of lists with the same smallest class."""
    entries = docs.select("text").mapInArrow(_entries(rule, clashes), "key long, v long, code int")
    # both readers need all columns and test for null, so one exchange serves them
    dealt = entries.where("key is not null and v is not null").repartition("key")
    found = dealt.groupBy("key").agg(F.min("v").alias("r"), F.max("v").alias("x"), F.count("code").alias("c"))
    shared = dealt.join(found.where("r <> x").select("key", "c"), "key").repartition("v").distinct()
    longest = Window.partitionBy("v", F.col("code") % 4).orderBy(F.desc("c"), "key")
    left = shared.withColumn("at", F.row_number().over(longest)).where(F.expr("at > code div 4")).select("key", "v")
    entered = store(left, "entries")
    lists = entered.df.groupBy("key").agg(F.min("v").alias("r"), F.max("v").alias("x")).where("r <> x").select("key", "r")
    members = store(entered.df.join(lists, "key").where("v <> r").select("r", "v").distinct(), "members")
    entered.drop()
    return members


def _class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, rule: Rule, clashes: frozenset[int]) -> DataFrame:
    """v, tokens of the classes in ``wanted``, and of few others; of repeated rows repeated."""
    need = store(classes.join(wanted, "v", "left_semi").select("first.k"), "classes")
    keyed = docs.select(row_key().alias("k"), "text")
    bits, hashes = bloom.plan(max(1, need.df.count()), 10.0)
    if bits <= MAX_BITS:
        words = store(bloom.build(need.df, "k", bits, hashes, 7), "bloom")
        keyed = bloom.within(keyed, "k", words.df, bits, hashes, 7)
    else:
        keyed = keyed.join(need.df, "k", "left_semi")
    return keyed.select("text").mapInArrow(_sets(rule, clashes), "v long, tokens binary")


def _panelled(grouped: DataFrame) -> DataFrame:
    """The rows (r, v) by blocks i of their group of c, the group's panel in each of its blocks."""
    panel = min(PANEL, BLOCK // 4)
    blocks = F.when(F.col("c") <= BLOCK, 1).otherwise(F.ceil(F.col("c") / (BLOCK - panel))).cast("int")
    placed = grouped.withColumn("nb", blocks)
    own = F.pmod(F.xxhash64("v"), F.col("nb")).cast("int")
    chosen = (F.col("nb") > 1) & (F.pmod(F.xxhash64("v", F.lit(1)), F.col("c")) < panel)
    spots = F.when(chosen, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(own))
    return placed.withColumn("i", F.explode(spots)).select("r", "v", "i", F.lit(0).alias("j"), F.lit(0).alias("b"))


def _block_pairs(every: DataFrame) -> DataFrame:
    """The rows (r, v, ...) of each pair i <= j of blocks of their group, with their block b."""
    count = every.groupBy("r").agg(F.count("*").alias("c"))
    blocks = store(count.select("r", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb")), "counts").df
    placed = every.join(blocks, "r").withColumn("b", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int"))
    other = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return other.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).drop("o", "nb")


def _apart_pairs(placed: DataFrame) -> DataFrame:
    """The rows (r, v, comp) of groups in several components, by pairs i, j of blocks: those outside the largest one with each other and with it."""
    sizes = placed.groupBy("r", "comp").agg(F.count("*").alias("c"))
    most = sizes.groupBy("r").agg(F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("big"), F.count("*").alias("comps"))
    split = store(most.where("comps > 1").select("r", "c", F.col("big.comp").alias("main"), F.col("big.c").alias("held")), "split").df
    small = F.col("c") <= BLOCK
    rest = F.when(small, 1).otherwise(F.ceil((F.col("c") - F.col("held")) / BLOCK)).cast("int")
    main = F.when(small, 0).otherwise(F.ceil(F.col("held") / BLOCK)).cast("int")
    known = placed.join(split, "r").withColumns({"nr": rest, "nm": main})
    outside = small | (F.col("comp") != F.col("main"))
    spot = F.xxhash64("v")
    block = F.when(outside, F.pmod(spot, F.col("nr"))).otherwise(F.col("nr") + F.pmod(spot, F.greatest("nm", F.lit(1)))).cast("int")
    others = F.when(outside, F.sequence(F.lit(0), F.col("nr") + F.col("nm") - 1)).otherwise(F.sequence(F.lit(0), F.col("nr") - 1))
    dealt = known.withColumn("b", block).withColumn("o", F.explode(others))
    return dealt.select("r", "v", "comp", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b")


def _sketched(base: DataFrame, wanted: DataFrame) -> Stored:
    """v, n, sketch of the classes in ``wanted``, and of few others."""
    some, rows_ = wanted.distinct(), base.where("v is not null").select("v", "n", "sketch")
    bits, hashes = bloom.plan(max(1, some.count()), 10.0)
    if bits <= MAX_BITS:
        words = store(bloom.build(some, "v", bits, hashes, 9), "bloom")
        rows_ = bloom.within(rows_, "v", words.df, bits, hashes, 9)
    else:
        rows_ = rows_.join(some, "v", "left_semi")
    return store(rows_.groupBy("v").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")


def linked_classes(docs: DataFrame, base: DataFrame, classes: DataFrame, rule: Rule, clashes: frozenset[int]) -> Stored:
    """u, root: the components of the classes, by verified links that connect exactly what all links connect."""
    members = _members(docs, rule, clashes)
    every = members.df.unionByName(members.df.select("r", F.col("r").alias("v")).distinct())
    counts = store(every.groupBy("r").agg(F.count("*").alias("c")), "counts")
    grouped = store(every.join(counts.df, "r"), "grouped")
    sketched = _sketched(base, grouped.df.select("v"))

    def candidates(dealt: DataFrame, most: int) -> DataFrame:
        with_sketch = dealt.join(sketched.df, "v").select("r", "i", "j", "b", "v", "n", "comp", "sketch")
        sorted_ = with_sketch.repartition("r", "i", "j").sortWithinPartitions("r", "i", "j", "v")
        return sorted_.mapInArrow(_candidates(rule, most), "u long, v long").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct()

    tested = [store(candidates(_panelled(grouped.df).withColumn("comp", F.col("v")), 0), "pairs")]
    # a group of one block has been compared as a whole: who has no pair there has no link there
    nodes = store(tested[0].df.select(F.explode(F.array("u", "v")).alias("v")).distinct(), "nodes")
    whole = grouped.df.where(F.col("c") <= BLOCK).join(nodes.df, "v", "left_semi").select("r", "v")
    might = store(whole.unionByName(grouped.df.where(F.col("c") > BLOCK).select("r", "v")), "might")
    wanted = might.df.select("v").unionByName(nodes.df).distinct()
    sets = store(_class_sets(docs, classes, wanted, rule, clashes), "sets")

    def verified(pairs: DataFrame) -> Stored:
        left = pairs.join(sets.df.select(F.col("v").alias("u"), F.col("tokens").alias("a")), "u")
        both = left.join(sets.df.withColumnRenamed("tokens", "b"), "v").select("u", "v", "a", "b")
        return store(both.mapInArrow(_verified(rule), "u long, v long").distinct(), "links")

    found = verified(tested[0].df)
    known = connected_components(found.df)
    found.drop()
    for most in ROUNDS:
        placed = might.df.join(known.df.select(F.col("u").alias("v"), "root"), "v", "left").select(
            "r", "v", F.coalesce("root", "v").alias("comp")
        )
        more = store(candidates(_apart_pairs(placed), most), "pairs")
        new = store(more.df.where("u <> v").join(_union(tested), ["u", "v"], "left_anti"), "pairs")
        left_out = not more.df.where("u = v").isEmpty()
        more.drop()
        tested.append(new)
        if not new.df.isEmpty():
            found = verified(new.df)
            known = extended(known, found.df)
            found.drop()
        if not left_out:
            break
    for held in (members, counts, grouped, sketched, nodes, might, sets, *tested):
        held.drop()
    return known


def _union(tables: list[Stored]) -> DataFrame:
    out = tables[0].df
    for t in tables[1:]:
        out = out.unionByName(t.df)
    return out


def _counted(docs: DataFrame, classes: DataFrame, comp: DataFrame, rule: Rule, clashes: frozenset[int]) -> Stored:
    """v, n_links of every class: the rows linked with a row of it, other rows of the class among them."""
    placed = comp.select(F.col("u").alias("v"), F.col("root").alias("r"))
    nodes = store(placed.unionByName(comp.select(F.col("root").alias("v"), F.col("root").alias("r")).distinct()), "nodes")
    sets = store(_class_sets(docs, classes, nodes.df.select("v"), rule, clashes), "sets")
    weights = classes.select("v", "m")
    carried = sets.df.dropDuplicates(["v"]).join(weights, "v")
    dealt = _block_pairs(nodes.df).join(carried, "v").select("r", "i", "j", "b", "v", "m", "tokens")
    sorted_ = dealt.repartition("r", "i", "j").sortWithinPartitions("r", "i", "j", "v")
    parts = sorted_.mapInArrow(_degrees(rule), "v long, degree long").groupBy("v").agg(F.sum("degree").alias("degree"))
    counted = store(
        weights.join(parts, "v", "left").select("v", (F.coalesce("degree", F.lit(0)) + F.col("m") - 1).alias("n_links")), "counted"
    )
    nodes.drop()
    sets.drop()
    return counted


def _joined(docs: DataFrame, rule: Rule, count: bool) -> tuple[Stored, Stored, Stored | None]:
    """The digests, for each class of several rows or with links the first row of its component, and links by class."""
    given = docs.select("doc_id", "text")
    base, clashes = digests(given, rule)
    # a null doc_id comes after all others
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    classes = store(
        base.df.where("v is not null").groupBy("v").agg(F.count("*").alias("m"), F.min(row).alias("first")), "classes"
    )
    comp = linked_classes(given, base.df, classes.df, rule, clashes)
    counted = _counted(given, classes.df, comp.df, rule, clashes) if count else None
    placed = comp.df.select(F.col("u").alias("v"), "root").unionByName(comp.df.select(F.col("root").alias("v"), "root").distinct())
    tied = store(placed.join(classes.df.select("v", "first"), "v"), "tied")
    lows = store(tied.df.groupBy("root").agg(F.min("first").alias("low")), "lows")
    linked = tied.df.join(lows.df, "root").select("v", "low")
    alone = classes.df.where("m > 1").join(tied.df.select("v"), "v", "left_anti").select("v", F.col("first").alias("low"))
    known = store(linked.unionByName(alone), "known")
    for old in (classes, comp, tied, lows):
        old.drop()
    return base, known, counted


@scratch.tidy
def join(docs: DataFrame, rule: Rule, count: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of ``docs``; with ``count`` also n_links.

    ``component_id`` is the smallest doc_id of the component, for an empty set the
    document's own; ``n_links`` is the number of other rows linked with the row.
    """
    base, known, counted = _joined(docs, rule, count)
    out = base.df.select("doc_id", "n", "v").join(known.df, "v", "left")
    extra = []
    if counted is not None:
        out = out.join(counted.df, "v", "left")
        extra = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    own = F.when(F.col("low").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), *extra, own.alias("component_id"))


@scratch.tidy
def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """The columns of ``docs``, without all but the smallest row (doc_id, then text's hash) of each component.

    Documents with an empty set stay, one row of each repeated row.
    """
    base, known, _ = _joined(docs, rule, False)
    linked = base.df.join(known.df, "v").select("k", (F.col("k") == F.col("low.k")).alias("keep"))
    empty = base.df.where("v is null").groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k", F.lit(True).alias("keep"))
    touched = store(linked.unionByName(empty).distinct(), "touched")
    base.drop()
    known.drop()
    bits, hashes = bloom.plan(max(1, touched.df.count()), 10.0)
    keyed = rows.carry(docs, key=row_key())
    if bits <= MAX_BITS:
        words = store(bloom.build(touched.df, "k", bits, hashes, 8), "bloom")
        free = bloom.within(keyed, "key", words.df, bits, hashes, 8, held=False).select("row")
        inside = bloom.within(keyed, "key", words.df, bits, hashes, 8)
    else:  # every row takes the join
        free, inside = keyed.where("false").select("row"), keyed
    decided = inside.join(touched.df.withColumnRenamed("k", "key"), "key", "left")
    single = decided.where("keep is null").select("row")
    kept = decided.where("keep").dropDuplicates(["key"]).select("row")
    return free.unionByName(single).unionByName(kept).select(*rows.restore(docs.columns))
