"""Continuous periods and gaps of closed integer intervals, by dyadic decomposition.

Every interval is cut into canonical dyadic blocks (level k, index i covers ``[i*2^k, (i+1)*2^k - 1]``), blocks below
a present ancestor are removed, sibling pairs are merged upward level by level, and adjacent blocks are coalesced.

Scale: an interval is first split at the borders of tiles of ``2^TILE`` positions into at most two pieces within a tile and
one range of whole tiles, so that no task sees a whole entity: of the pieces that start at one place only the longest goes
on (aggregated before the shuffle), which leaves a tile at most ``2^TILE`` rows however many intervals it has. The blocks
of a tile live only inside its task. Across tiles an entity has its first and last run of each tile and its ranges of
whole tiles, bounded by the number range of the positions (``2^(32-TILE)`` tiles), again not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelica.functions.keys import materialize, require_columns

#: Level from which blocks are handled across tiles.
TILE = 20
#: Added to every position: makes all 32-bit values non-negative without moving dyadic borders.
OFFSET = 1 << 31
TOP = 34


def dyadic_blocks(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, level) of the canonical dyadic blocks of half-open intervals: at most two per level and interval."""
    g, a, b, out = group, lo, hi, []
    for k in range(TOP):
        live = a < b
        if not live.all():
            g, a, b = g[live], a[live], b[live]
        if not len(g):
            break
        odd = (a & 1).astype(bool)
        out.append((g[odd], a[odd] << k, np.full(int(odd.sum()), k)))
        a = a + odd
        odd = ((b & 1).astype(bool)) & (a < b)
        out.append((g[odd], (b[odd] - 1) << k, np.full(int(odd.sum()), k)))
        a, b = a >> 1, (b - odd) >> 1
    g, s, k = (np.concatenate(c) for c in zip(*out)) if out else (group[:0], lo[:0], lo[:0])
    return g, s, k


def canonical(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, level) of the fewest dyadic blocks that cover what half-open intervals of each group cover, in order:
    blocks below another are dropped, siblings merged until there are none."""
    g, s, k = dyadic_blocks(group, lo, hi)
    order = np.lexsort((-k, s, g))
    g, s, k = g[order], s[order], k[order]
    # blocks nest or are disjoint: one is covered exactly if an earlier one in (start, widest first) order reaches its end
    reach = (g << TOP) + s + (np.int64(1) << k)
    keep = np.ones(len(g), bool)
    keep[1:] = np.maximum.accumulate(reach)[:-1] < reach[1:]
    g, s, k = g[keep], s[keep], k[keep]
    # siblings are neighbours now; a merged pair may be the sibling of the next level
    for level in range(int(k.min()) if len(k) else TOP, TOP - 1):
        if len(k) < 2:
            break
        here = k == level
        left = here[:-1] & here[1:] & (g[:-1] == g[1:]) & ((s[:-1] >> level) & 1 == 0) & (s[1:] - s[:-1] == 1 << level)
        if left.any():
            k[:-1][left] += 1
            keep = np.ones(len(k), bool)
            keep[1:][left] = False
            g, s, k = g[keep], s[keep], k[keep]
    return g, s, k


def union(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, end) of the maximal stretches that half-open intervals of each group cover, in order."""
    g, s, k = canonical(group, lo, hi)
    e = s + (np.int64(1) << k)
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (s[1:] != e[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(g)) - 1 if len(g) else first
    return g[first], s[first], e[last]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables that end where a group of ``keys`` ends, with the number of each row's group in its table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b]).combine_chunks()
        starts = _starts(t, keys)
        if starts[-1] > 0:
            done = t.slice(0, starts[-1])
            yield done, np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            t = t.slice(starts[-1])
        held = t.to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.zeros(t.num_rows, "int64")


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        c = t.column(k).combine_chunks()
        new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), bool)
    return np.flatnonzero(new)


def _in_tiles(keys: list[str]):
    """Runs of each tile: their bounds, the next run of the tile, and whether they are its first or last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, [*keys, "tile"]):
            g, s, e = union(group, np.asarray(t.column("a")), np.asarray(t.column("b")))
            row = np.searchsorted(group, g)
            new = np.append(True, g[1:] != g[:-1])
            end = np.append(new[1:], True)
            nxt = pa.array(np.append(s[1:], 0), mask=end)
            cols = [*[t.column(k).combine_chunks().take(pa.array(row)) for k in [*keys, "tile"]], pa.array(s), pa.array(e), nxt, pa.array(new | end)]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "tile", "s", "e", "next", "edge"])

    return run


def _across(keys: list[str]):
    """Of each entity: the periods that begin or end at the edge of a tile, the gaps between tiles, and the tiles that a
    range of whole tiles covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, keys):
            tile, a, b = (np.asarray(t.column(c)) for c in ("tile", "s", "e"))
            g, s, e = union(group, a, b)
            near = (g[1:] == g[:-1]) & ((e[:-1] - 1) >> TILE != s[1:] >> TILE)
            wide, low = tile < 0, tile >= 0
            hg, hs, he = union(group[wide], a[wide], b[wide])
            at = np.searchsorted((hg << TOP) + hs, (group[low] << TOP) + (tile[low] << TILE), side="right") - 1
            inside = (at >= 0) & (hg[at] == group[low]) & (he[at] > tile[low] << TILE) if len(hg) else np.zeros(int(low.sum()), bool)
            cg, ct = group[low][inside], tile[low][inside]
            who = np.concatenate([g, g[:-1][near], cg])
            kind = np.repeat(["period", "gap", "tile"], [len(g), int(near.sum()), len(cg)])
            row = pa.array(np.searchsorted(group, who))
            cols = [*[t.column(k).combine_chunks().take(row) for k in keys], pa.array(kind, pa.string()), pa.array(np.concatenate([s, e[:-1][near], ct])), pa.array(np.concatenate([e, s[1:][near], ct]))]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "kind", "s", "e"])

    return run


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Maximal covered stretches and the gaps between them per entity.

    Returns ``keys, kind ('period' | 'gap'), start, end`` (closed, named ``start_bp``/``end_bp``). Rows with a null key,
    start or end are ignored, reversed bounds mean the same stretch, repeated rows count once, stretches that share a
    position or are directly adjacent belong together. An empty table gives an empty result. Other columns, also ones
    named like the output's, are not read.
    """
    require_columns(df, *keys, start, end)
    k = [f"_k{i}" for i in range(len(keys))]
    head = [T.StructField(a, df.schema[c].dataType) for c, a in zip(keys, k)]
    long = [T.StructField(n, T.LongType()) for n in ("s", "e")]
    d = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).dropna(subset=keys)
    l, r = F.least(start, end).cast("long") + OFFSET, F.greatest(start, end).cast("long") + OFFSET + 1
    d = d.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], l.alias("l"), r.alias("r"))
    # whole tiles t1 .. t2 - 1 (t1 > t2: all within one tile); a range of them is filed under tile -1
    d = d.select(*k, "l", "r", F.expr(f"shiftright(l + {(1 << TILE) - 1}L, {TILE})").alias("t1"), F.expr(f"shiftright(r, {TILE})").alias("t2"))
    b1, b2 = f"shiftleft(t1, {TILE})", f"shiftleft(t2, {TILE})"
    pieces = f"""array(case when t1 > t2 then struct(t2 as tile, l as a, r as b) when l < {b1} then struct(t1 - 1 as tile, l as a, {b1} as b) end,
        case when t1 <= t2 and r > {b2} then struct(t2 as tile, {b2} as a, r as b) end, case when t1 < t2 then struct(-1L as tile, {b1} as a, {b2} as b) end)"""
    d = d.select(*k, F.explode(F.expr(f"filter({pieces}, x -> x is not null)")).alias("x"))
    d = d.groupBy(*k, F.col("x.tile").alias("tile"), F.col("x.a").alias("a")).agg(F.max("x.b").alias("b"))
    d = d.repartition(*k, "tile").sortWithinPartitions(*k, "tile", "a")
    runs = T.StructType([*head, T.StructField("tile", T.LongType()), *long, T.StructField("next", T.LongType()), T.StructField("edge", T.BooleanType())])
    # read three times from here on and far fewer than the intervals' blocks
    runs = materialize(d.mapInArrow(_in_tiles(k), runs), "runs")
    edges = runs.where("edge or tile < 0").select(*k, "tile", "s", "e").repartition(*k).sortWithinPartitions(*k, "s")
    across = materialize(edges.mapInArrow(_across(k), T.StructType([*head, T.StructField("kind", T.StringType()), *long])), "across")
    covered = across.where("kind = 'tile'").select(*k, F.col("s").alias("tile"))
    inner = runs.where("tile >= 0 and (not edge or next is not null)").join(covered, [*k, "tile"], "left_anti")
    both = F.expr("filter(array(struct('period' as kind, s as s, e as e), struct('gap' as kind, e as s, next as e)), x -> x.e is not null and not (edge and x.kind = 'period'))")
    inner = inner.select(*k, F.explode(both).alias("x")).select(*k, "x.kind", "x.s", "x.e")
    out = inner.unionByName(across.where("kind <> 'tile'"))
    return out.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], "kind", (F.col("s") - OFFSET).cast("int").alias("start_bp"), (F.col("e") - 1 - OFFSET).cast("int").alias("end_bp"))
