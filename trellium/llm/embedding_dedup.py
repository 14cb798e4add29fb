"""Embedding near-duplicates with hierarchical navigable small-world graphs per shard.

Method. Vectors of one label (and one length) are dealt by hash into shards of bounded
size, and a graph is built in each: every vector gets a top level by hash, and on each
level up to it the points are put in one after the other, a block at a time, each linked
to near and mutually diverse points that are in already, and these back to it. A graph's
beam is doubled until an audit passes: a sample of queries, and where they have few links
also vectors planted at a known cosine, is compared with brute force, and
``AUDIT_RECALL`` of the true links must be found, a query's link to itself left out. A
beam as large as the shard gives way to comparing with all of it. Every vector is then queried against every
shard of its label, with the beam of that shard's audit or more if the audit of the pair
of shards asks for it: greedy descent, a beam on the ground level, and from what lies
above the threshold a walk over all linked vectors above it. What is found is verified by
cosine in double precision, of vectors that a power of two has brought near 1, so that
no size of theirs over- or underflows. Links become degrees and components.

Scale. Equal vectors of a label are one point with a count, so copies are never expanded.
A shard holds at most ``SHARD_ROWS`` vectors and ``SHARD_FLOATS`` numbers, whatever the
label's size; a label with a third of all rows has more shards. Shards meet in pairs of
blocks of ``SIDE`` shards, so a shard is shuffled once per block of its label, not once
per shard. Found links are held for one batch of queries, then as one bit a pair of
points of a shard; a task returns one degree and one edge a point, never pairs.

Defined results. A vector that is null, zero, empty or holds a null or non-finite
component, or whose label is null, links with nothing. Vectors of different length are
not compared. Repeated rows are rows of their own, linked if they are valid, also where
they have one vec_id. A row without vec_id takes part in links; its component is the
smallest vec_id that it reaches, null if there is none. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm import scratch
from trellium.llm.components import connected_components
from trellium.llm.scratch import store

THRESHOLD = 0.98
SHARD_ROWS = 16384
#: Numbers of a shard: 32 MB in double precision.
SHARD_FLOATS = 1 << 22
SIDE = 4
NEIGHBOURS = 12
GROUND = 24
CANDIDATES = 32
LEVELS = 6
BEAM = 16
AUDIT = 128
AUDIT_RECALL = 0.99
#: Audits with fewer true links than this plant vectors at a cosine between the threshold and 1.
AUDIT_LINKS = 64
#: Points put in, queries run and pairs compared at a time.
BLOCK, QUERIES, PAIRS = 512, 512, 1 << 15
#: The graph is in single precision; what is this near below the threshold is verified too.
HAIR = 1e-5


def _pair_dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The dot products a[i] * b[j], a bounded number at a time."""
    out = np.empty(len(i), a.dtype)
    for at in range(0, len(i), PAIRS):
        to = at + PAIRS
        np.einsum("nd,nd->n", a[i[at:to]], b[j[at:to]], out=out[at:to])
    return out


def _choose(unit: np.ndarray, candidates: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1: none), nearest first: those nearer to the point than to others chosen before, then the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
    rows, width = candidates.shape
    held = unit[np.maximum(candidates, 0)]
    cross = held @ held.transpose(0, 2, 1)
    closest, chosen, taken = np.full((rows, width), -2, unit.dtype), np.zeros((rows, width), bool), np.zeros(rows, int)
    for k in range(width):
        take = (candidates[:, k] >= 0) & (sims[:, k] > closest[:, k]) & (taken < most)
        chosen[:, k] = take
        taken += take
        np.maximum(closest, np.where(take[:, None], cross[:, k], -2), out=closest)
    rank = np.where(candidates < 0, 2 * width, np.where(chosen, 0, width) + np.arange(width))
    first = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(candidates, first, 1)


def _nearest(sims: np.ndarray, most: int) -> np.ndarray:
    """The columns of the ``most`` largest numbers of each row, in no order."""
    if sims.shape[1] <= most:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.argpartition(-sims, most - 1, axis=1)[:, :most]


def _level(unit: np.ndarray, degree: int) -> np.ndarray:
    """The links of one level, -1 for none: points go in by blocks, each linked to what is in before it."""
    n = len(unit)
    links = np.full((n, degree), -1, np.int32)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        sims = unit[a:b] @ unit[:b].T
        sims[np.arange(b) >= np.arange(a, b)[:, None]] = -4
        near = _nearest(sims, CANDIDATES)
        close = np.take_along_axis(sims, near, 1)
        mine = _choose(unit, np.where(close > -3, near, -1).astype(np.int32), close, min(NEIGHBOURS, degree))
        links[a:b, : mine.shape[1]] = mine
        i, k = np.nonzero(mine >= 0)
        _link_back(unit, links, mine[i, k], (a + i).astype(np.int32))
    return links


def _link_back(unit: np.ndarray, links: np.ndarray, j: np.ndarray, i: np.ndarray) -> None:
    """Links each j to its i; a row that is full keeps a diverse choice of what it had and its nearest new ones."""
    if not len(j):
        return
    degree = links.shape[1]
    sims = _pair_dots(unit, j, unit, i)
    order = np.lexsort((i, -sims, j))
    j, i = j[order], i[order]
    new = np.concatenate([[True], j[1:] != j[:-1]])
    start = np.flatnonzero(new)
    place = np.arange(len(j)) - start[np.cumsum(new) - 1]
    some = place < degree
    points, row = j[start], np.cumsum(new) - 1
    fresh = np.full((len(points), degree), -1, np.int32)
    fresh[row[some], place[some]] = i[some]
    fresh = fresh[:, : int(place[some].max()) + 1]
    for at in range(0, len(points), BLOCK):
        mine = points[at : at + BLOCK]
        both = np.concatenate([links[mine], fresh[at : at + BLOCK]], axis=1)
        close = np.einsum("nd,nkd->nk", unit[mine], unit[np.maximum(both, 0)])
        close[both < 0] = -4
        full = (both >= 0).sum(axis=1) > degree
        order = np.argsort(both < 0, axis=1, kind="stable")[:, :degree]
        kept = np.take_along_axis(both, order, 1)
        if full.any():
            kept[full] = _choose(unit, both[full], close[full], degree)
        links[mine] = kept


class Graph:
    """A navigable small-world graph over unit vectors; ``levels`` are (points, links between their numbers), ground first."""

    def __init__(self, unit: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.unit, self.levels = unit, levels

    def beams(self, q: np.ndarray, starts: np.ndarray, ef: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and similarities of the ``ef`` best points that a best-first search finds for each query, best first; -1 for none."""
        points, links = self.levels[level]
        unit = self.unit if level == 0 else self.unit[points]
        rows, deg = len(q), links.shape[1]
        ids, sims, done = np.full((rows, ef), -1, np.int32), np.full((rows, ef), -np.inf, np.float32), np.ones((rows, ef), bool)
        ids[:, 0], done[:, 0] = starts, False
        sims[:, 0] = np.einsum("nd,nd->n", unit[starts], q)
        seen = np.zeros((rows, len(unit)), bool)
        seen[np.arange(rows), starts] = True
        live = np.arange(rows)
        while len(live):
            pick = np.argmin(done[live], axis=1)
            here = ids[live, pick]
            done[live, pick] = True
            around = links[here]
            known = np.maximum(around, 0)
            new = (around >= 0) & ~seen[live[:, None], known]
            x = np.full((len(live), deg), -np.inf, np.float32)
            r, k = np.nonzero(new)
            seen[live[r], known[r, k]] = True
            x[r, k] = np.einsum("nd,nd->n", unit[known[r, k]], q[live[r]])
            all_sims = np.concatenate([sims[live], x], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, around, -1)], axis=1), best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~new], axis=1), best, 1)
            live = live[~done[live].all(axis=1)]
        return ids, sims

    def descend(self, q: np.ndarray) -> np.ndarray:
        """Where each query meets the ground level."""
        at = np.zeros(len(q), np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            found = self.levels[level][0][self.beams(q, at, 1, level)[0][:, 0]]
            at = np.searchsorted(self.levels[level - 1][0], found)
        return at

    def within(self, q: np.ndarray, threshold: float, ef: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all found at ``threshold`` or more; a query that is a point of the graph may start there."""
        ids, sims = self.beams(q, self.descend(q) if starts is None else starts, ef, 0)
        links, n = self.levels[0][1], len(self.unit)
        seen = np.zeros((len(q), n), bool)
        r, k = np.nonzero(ids >= 0)
        seen[r, ids[r, k]] = True
        r, k = np.nonzero(sims >= threshold)
        out = [(r, ids[r, k])]
        ahead = [out[0]]
        while ahead:
            row, point = ahead.pop()
            for at in range(0, len(row), PAIRS):
                near = links[point[at : at + PAIRS]]
                who = np.repeat(row[at : at + PAIRS], near.shape[1])
                near = near.ravel()
                fresh = near >= 0
                fresh[fresh] = ~seen[who[fresh], near[fresh]]
                spot = np.unique(who[fresh].astype(np.int64) * n + near[fresh])
                if not len(spot):
                    continue
                who, near = spot // n, spot % n
                seen[who, near] = True
                good = _pair_dots(q, who, self.unit, near) >= threshold
                if good.any():
                    out.append((who[good], near[good].astype(np.int32)))
                    ahead.append(out[-1])
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def build(unit: np.ndarray, ids: np.ndarray) -> Graph:
    """The graph of unit vectors; levels depend on the ids alone, so reruns agree."""
    draw = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / 2**53
    tops = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(NEIGHBOURS)).astype(int), LEVELS)
    levels = []
    for level in range(int(tops.max(initial=0)) + 1):
        points = np.flatnonzero(tops >= level)
        levels.append((points, _level(unit[points], GROUND if level == 0 else NEIGHBOURS)))
    return Graph(unit, levels)


class Shard:
    """Points (the two halves c, e of a class, count, vector) with their graph and the beam that its audit asks for."""

    def __init__(self, c, e, m, x, levels: list[tuple[np.ndarray, np.ndarray]] | None = None, ef: int = BEAM):
        self.c, self.e, self.m, self.x, self.ef = c, e, m, x, ef
        self.norm = np.sqrt((x * x).sum(axis=1))
        unit = (x / self.norm[:, None]).astype(np.float32)
        self.graph = build(unit, c) if levels is None else Graph(unit, levels)

    def pack(self) -> bytes:
        out = io.BytesIO()
        levels = {f"{kind}{k}": part for k, pair in enumerate(self.graph.levels) for kind, part in zip("pl", pair, strict=True)}
        np.savez(out, c=self.c, e=self.e, m=self.m, x=self.x, ef=np.array(self.ef), **levels)
        return out.getvalue()

    @staticmethod
    def unpack(blob: bytes) -> Shard:
        held = np.load(io.BytesIO(blob))
        count = sum(name[0] == "l" for name in held.files)
        return Shard(held["c"], held["e"], held["m"], held["x"], [(held[f"p{k}"], held[f"l{k}"]) for k in range(count)], int(held["ef"]))


def _found(a: Shard, rows: np.ndarray, b: Shard, ef: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the links that the graph of b finds for the points ``rows`` of a, verified; no link of a point with itself."""
    if ef < len(b.c):
        who, j = b.graph.within(a.graph.unit[rows], threshold - HAIR, ef, rows if a is b else None)
    else:
        who, j = np.nonzero(a.graph.unit[rows] @ b.graph.unit.T >= threshold - HAIR)
    i = rows[who]
    if a is b:
        other = i != j
        i, j = i[other], j[other]
    keep = _pair_dots(a.x, i, b.x, j) / (a.norm[i] * b.norm[j]) >= threshold
    return i[keep], j[keep]


def _recall(a: Shard, b: Shard, ef: int, threshold: float) -> float:
    """The share of the true links of a sample of a's points, and of planted vectors if it has few, that the graph of b finds."""
    sample = np.argsort(a.c * np.int64(-7046029254386353131), kind="stable")[:AUDIT]
    cosine = (a.x[sample] @ b.x.T) / np.outer(a.norm[sample], b.norm)
    if a is b:
        cosine[np.arange(len(sample)), sample] = -1
    true = int((cosine >= threshold).sum())
    found = len(_found(a, sample, b, ef, threshold)[0])
    if true < AUDIT_LINKS and b.x.shape[1] > 1:
        near = np.argsort(b.c * np.int64(-7046029254386353131), kind="stable")[:AUDIT]
        rng = np.random.default_rng(len(b.c))
        unit = b.x[near] / b.norm[near, None]
        aside = rng.normal(size=unit.shape)
        aside -= (aside * unit).sum(axis=1, keepdims=True) * unit
        length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
        cos = threshold + (1 - threshold) / 4
        planted = (cos * unit + np.sqrt(1 - cos * cos) * aside / np.maximum(length, 1e-300)).astype(np.float32)
        want = planted @ b.graph.unit.T >= threshold
        true += int(want.sum())
        who, at = b.graph.within(planted, threshold, ef)
        found += int(want[who, at].sum())
    return found / true if true else 1.0


def _beam(a: Shard, b: Shard, ef: int, threshold: float) -> int:
    """The first beam, doubled from ``ef`` on, that the audit passes."""
    while ef < len(b.c) and _recall(a, b, ef, threshold) < AUDIT_RECALL:
        ef *= 2
    return min(ef, len(b.c))


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives the points of a component the smallest number in it; ``label`` holds that of earlier links."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _links(a: Shard, b: Shard, threshold: float) -> pd.DataFrame:
    """Of two shards, or one with itself, class c, e: the rows it is linked with, or the class uc, ue of its component."""
    same, n = a is b, len(a.c)
    ef = a.ef if same else _beam(a, b, max(a.ef, b.ef), threshold)
    degrees = [np.zeros(n, np.int64), np.zeros(len(b.c), np.int64)]
    label = np.arange(n if same else n + len(b.c))
    bits = np.zeros((n, -(-n // 8)) if same else (0, 0), np.uint8)
    for at in range(0, n, QUERIES):
        i, j = _found(a, np.arange(at, min(n, at + QUERIES)), b, ef, threshold)
        _join_labels(label, i, j if same else j + n)
        if same:
            # a link found from either end counts for both
            for u, v in ((i, j), (j, i)):
                np.bitwise_or.at(bits, (u, v >> 3), np.left_shift(1, v & 7).astype(np.uint8))
        else:
            np.add.at(degrees[0], i, b.m[j])
            np.add.at(degrees[1], j, a.m[i])
    if same:
        for at in range(0, n, QUERIES):
            degrees[0][at : at + QUERIES] = np.unpackbits(bits[at : at + QUERIES], axis=1, count=n, bitorder="little") @ a.m
    sides = [a] if same else [a, b]
    c, e, degree = (np.concatenate(x) for x in ([s.c for s in sides], [s.e for s in sides], degrees[: len(sides)]))
    some, moved = np.flatnonzero(degree), np.flatnonzero(label != np.arange(len(label)))
    linked = pd.DataFrame({"c": c[some], "e": e[some], "n": degree[some], "uc": 0, "ue": 0})
    tied = pd.DataFrame({"c": c[moved], "e": e[moved], "n": 0, "uc": c[label[moved]], "ue": e[label[moved]]})
    return pd.concat([linked, tied], ignore_index=True).astype("int64")


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector by a power of two, so that its largest component lies between 1/2 and 1: its directions stay, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _index(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["c", "e"])
        x = scaled(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
        shard = Shard(*(rows[k].to_numpy(np.int64) for k in "cem"), x)
        shard.ef = _beam(shard, shard, BEAM, threshold)
        first = rows.iloc[0]
        return pd.DataFrame({"g": [first["g"]], "shard": [first["shard"]], "shards": [first["shards"]], "blob": [shard.pack()]})

    return run


def _search(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        blobs = dict(zip(rows["shard"], rows["blob"], strict=True))
        shards = {k: Shard.unpack(blobs.pop(k)) for k in sorted(blobs)}
        left, right = ([k for k in shards if k // SIDE == side] for side in (first["i"], first["j"]))
        return pd.concat([_links(shards[i], shards[j], threshold) for i in left for j in right if i <= j], ignore_index=True)

    return run


@scratch.tidy
def dedup(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors``."""
    x = F.col("embedding").cast("array<double>")
    inf = float("inf")
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf)) & F.exists("x", lambda v: v != 0)
    held = vectors.select("vec_id", "label", x.alias("x"))
    ok = F.coalesce(sound & F.col("label").isNotNull(), F.lit(False))
    # 128 bits, so that no two classes share a key at any size
    c, e = F.xxhash64("label", "x"), F.xxhash64(F.lit(1), "label", "x")
    keyed = held.select("vec_id", F.when(ok, c).alias("c"), F.when(ok, e).alias("e"), "label", F.size("x").alias("d"), "x")
    classes = store(
        keyed.where("c is not null").groupBy("c", "e").agg(
            F.first("d").alias("d"), F.md5(F.concat_ws(":", F.first("d"), F.first("label").cast("string")).cast("binary")).alias("g"), F.first("x").alias("embedding"),
            F.count("*").alias("m"), F.min("vec_id").alias("least"),
        ), "points"
    )
    fits = F.greatest(F.least(F.lit(shard_rows), F.expr(f"{SHARD_FLOATS} div d")), F.lit(1))
    counts = classes.df.groupBy("g").agg(F.max("d").alias("d"), F.count("*").alias("n")).select("g", F.ceil(F.col("n") / fits).cast("int").alias("shards"))
    dealt = classes.df.join(counts, "g").withColumn("shard", F.pmod(F.xxhash64("c", F.lit(1)), F.col("shards")).cast("int"))
    indexes = store(
        dealt.select("g", "shard", "shards", "c", "e", "m", "embedding").groupBy("g", "shard").applyInPandas(_index(threshold), "g string, shard int, shards int, blob binary"),
        "graphs",
    )
    block = F.expr(f"shard div {SIDE}").cast("int")
    others = F.explode(F.sequence(F.lit(0), F.expr(f"(shards - 1) div {SIDE}").cast("int")))
    sides = indexes.df.withColumn("o", others).select(
        "g", "shard", "blob", F.least(block, "o").alias("i"), F.greatest(block, "o").alias("j")
    )
    found = store(sides.groupBy("g", "i", "j").applyInPandas(_search(threshold), "c long, e long, n long, uc long, ue long"), "found")
    indexes.drop()
    # a node leads with its least vec_id, nulls last, so a component's smallest node tells its id
    node = F.struct(F.col("least").isNull().alias("none"), "least", "c", "e")
    nodes = classes.df.select("c", "e", node.alias("node"))
    tied = found.df.where("n = 0").select("c", "e", "uc", "ue").join(nodes.withColumnRenamed("node", "u"), ["c", "e"])
    ends = nodes.select(F.col("c").alias("uc"), F.col("e").alias("ue"), F.col("node").alias("v"))
    comp = connected_components(tied.join(ends, ["uc", "ue"]).select("u", "v"))
    degrees = found.df.where("n > 0").groupBy("c", "e").agg(F.sum("n").alias("degree"))
    roots = comp.df.select("u.c", "u.e", F.col("root.least").alias("component_id"))
    known = store(
        classes.df.select("c", "e", "m", "least").join(degrees, ["c", "e"], "left").join(roots, ["c", "e"], "left").select(
            "c", "e", (F.coalesce("degree", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
        ), "known"
    )
    for old in (classes, found, comp):
        old.drop()
    return keyed.select("vec_id", "c", "e").join(known.df, ["c", "e"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
