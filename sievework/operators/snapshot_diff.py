"""What changed between full snapshots, by subtracting invertible Bloom lookup tables.

The records of a source are split into hash buckets, the same for all of its deliveries, and buckets of small sources share
a bin, so that a bin has about as many records as any other, whatever the source. One shuffle brings the records of a bin
together. There every delivery of a source becomes a table of cells; a cell holds the count and the XOR of all keys, digests
and marks thrown into it. Subtracting the tables of two consecutive deliveries cancels all equal records, so that what is
left is as large as the difference and not as large as the snapshot. Peeling cells that hold one record yields the differing
ones; a table that cannot be peeled is built again with more cells, and what is peeled is verified against stored records.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from sievework.shared import materialise

HASHES = 3


@dataclass(frozen=True)
class DiffSettings:
    """``rows_per_bin``: records of all deliveries that meet in one call. ``share``: cells of a table in the first attempt, as
    a share of the records of its largest delivery. ``growth``: by how much a failed table grows per attempt, until its cells
    outnumber its records, at which point peeling succeeds with all but vanishing probability; ``attempts`` only guards
    against endless loops, and running out of it raises. ``salts``: into how many parts the deliveries of a source are split
    where its records look up their neighbours, in case that takes a shuffle."""

    rows_per_bin: int = 32_768
    share: float = 0.375
    growth: int = 4
    attempts: int = 12
    salts: int = 16


def canonical_json(text: Column) -> Column:
    """The JSON value of a text in one spelling (sorted keys, no spacing); text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def squeezed(text: Column) -> Column:
    """Text with every run of white space as one blank, without outer ones."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# ---- tables of cells, as arrays


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of integers, element by element."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            h = (h ^ (part.view(np.uint64) if isinstance(part, np.ndarray) else np.uint64(part))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return h


def _xored(cells: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """XOR of the values of each cell; ``cells`` are sorted."""
    out = np.zeros(size, np.uint64)
    if len(cells):
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        out[cells[starts]] = np.bitwise_xor.reduceat(values, starts)
    return out


@dataclass
class _Records:
    """Records of a bin, one per delivery and key: number of the source, place of the delivery, key and digest."""

    source: np.ndarray
    place: np.ndarray
    hi: np.ndarray
    lo: np.ndarray
    digest: np.ndarray
    row: np.ndarray

    def where(self, keep: np.ndarray) -> "_Records":
        return _Records(*(getattr(self, f)[keep] for f in ("source", "place", "hi", "lo", "digest", "row")))


def _places(mark: np.ndarray, start: np.ndarray, third: np.ndarray, seed: int) -> np.ndarray:
    """One cell in each third of a table, so that a record never meets itself: an array of three rows."""
    return np.stack([start + i * third + (_mixed(mark, seed * HASHES + i) % third.astype(np.uint64)).astype(np.int64) for i in range(HASHES)])


def _peeled(records: _Records, pairs: np.ndarray, share: float, seed: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Differing records of pairs of deliveries, as arrays (pair, hi, lo, digest, sign), and which pairs failed.

    ``pairs`` has rows (source, place of the earlier delivery); the later one has the next place.
    """
    keys, delivery, rows = np.unique(np.stack([records.source, records.place], axis=1), axis=0, return_inverse=True, return_counts=True)
    delivery = delivery.reshape(-1)
    n_sources = int(records.source.max()) + 1
    largest = np.zeros(n_sources, np.int64)
    np.maximum.at(largest, keys[:, 0], rows)
    third = np.ceil(largest * share / HASHES).astype(np.int64) + 4
    # tables of deliveries, one behind the other, and behind them an empty one for deliveries without records in this bin
    sizes = HASHES * third[keys[:, 0]]
    start = np.cumsum(sizes) - sizes
    total, empty = int(sizes.sum()), int(HASHES * third.max())
    mark = _mixed(records.hi, records.lo, records.digest)
    cells = _places(mark, start[delivery], third[records.source], seed).reshape(-1)
    order = np.argsort(cells, kind="stable")
    tables = {"n": np.bincount(cells, minlength=total + empty).astype(np.int64)}
    for name, values in (("hi", records.hi), ("lo", records.lo), ("digest", records.digest), ("mark", mark)):
        tables[name] = _xored(cells[order], np.tile(values.view(np.uint64), HASHES)[order], total + empty)
    # subtraction of neighbours
    at = {(int(s), int(p)): int(b) for (s, p), b in zip(keys, start)}
    size = HASHES * third[pairs[:, 0]]
    begin = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(begin, size)
    later = np.repeat([at.get((int(s), int(p) + 1), total) for s, p in pairs], size) + within
    earlier = np.repeat([at.get((int(s), int(p)), total) for s, p in pairs], size) + within
    left = {"n": tables["n"][later] - tables["n"][earlier], **{k: tables[k][later] ^ tables[k][earlier] for k in ("hi", "lo", "digest", "mark")}}
    pair_of = np.repeat(np.arange(len(pairs)), size)
    found: list[np.ndarray] = []
    look = np.arange(len(pair_of))
    while len(look):
        one = look[np.abs(left["n"][look]) == 1]
        one = one[_mixed(left["hi"][one], left["lo"][one], left["digest"][one]) == left["mark"][one]]
        if not len(one):
            break
        hits = np.stack([pair_of[one].astype(np.uint64), left["hi"][one], left["lo"][one], left["digest"][one], (left["n"][one] + 1).astype(np.uint64)], axis=1)
        hits = np.unique(hits, axis=0)  # a record may stand alone in several of its cells
        found.append(hits)
        pair, sign = hits[:, 0].astype(np.int64), hits[:, 4].astype(np.int64) - 1
        mark = _mixed(hits[:, 1], hits[:, 2], hits[:, 3])
        cells = _places(mark, begin[pair], third[pairs[pair, 0]], seed)
        for i in range(HASHES):
            np.subtract.at(left["n"], cells[i], sign)
            for k, values in (("hi", hits[:, 1]), ("lo", hits[:, 2]), ("digest", hits[:, 3]), ("mark", mark)):
                np.bitwise_xor.at(left[k], cells[i], values)
        look = np.unique(cells)
    failed = np.zeros(len(pairs), bool)
    failed[pair_of[(left["n"] != 0) | (left["hi"] != 0) | (left["lo"] != 0) | (left["digest"] != 0) | (left["mark"] != 0)]] = True
    all_ = np.concatenate(found) if found else np.zeros((0, 5), np.uint64)
    return {"pair": all_[:, 0].astype(np.int64), "hi": all_[:, 1], "lo": all_[:, 2], "digest": all_[:, 3], "sign": all_[:, 4].astype(np.int64) - 1}, failed


def _located(records: _Records, source: np.ndarray, place: np.ndarray, hi: np.ndarray, lo: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """For each given record the index of the equal stored one, -1 for none."""
    mine = _mixed(records.source.astype(np.int64), records.place.astype(np.int64), records.hi, records.lo, records.digest)
    order = np.argsort(mine)
    at = order[np.minimum(np.searchsorted(mine[order], _mixed(source.astype(np.int64), place.astype(np.int64), hi, lo, digest)), len(order) - 1)]
    same = (records.source[at] == source) & (records.place[at] == place) & (records.hi[at].view(np.uint64) == hi) & (records.lo[at].view(np.uint64) == lo) & (records.digest[at].view(np.uint64) == digest)
    return np.where(same, at, -1)


def _differences(records: _Records, pairs: np.ndarray, settings: DiffSettings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices of records, signs) that make up the difference of each pair of deliveries. A sign of 1 stands for a record of
    the later delivery that the earlier one does not hold, -1 for the reverse."""
    share, open_pairs = settings.share, pairs
    for seed in range(settings.attempts):
        wanted = {(int(s), int(p) + k) for s, p in open_pairs for k in (0, 1)}
        own = records.where(np.fromiter(((int(s), int(p)) in wanted for s, p in zip(records.source, records.place)), bool, len(records.source))) if seed else records
        hits, failed = _peeled(own, open_pairs, share, seed)
        source, place = open_pairs[hits["pair"], 0], open_pairs[hits["pair"], 1] + (hits["sign"] > 0)
        at = _located(own, source, place, hits["hi"], hits["lo"], hits["digest"])
        failed[hits["pair"][at < 0]] = True  # a digest that no stored record has: the table is built again
        good = ~failed[hits["pair"]]
        yield own.row[at[good]], hits["sign"][good]
        if not failed.any():
            return
        open_pairs = open_pairs[failed]
        share *= settings.growth
    raise RuntimeError("a table could not be peeled; raise DiffSettings.attempts")


def _latest(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Indices of the last loaded row of each source, delivery and key; among equal ones the larger digest holds."""
    order = np.lexsort([columns[c] for c in ("digest", "loaded", "lo", "hi", "place", "source_hash")])
    key = np.stack([columns[c][order] for c in ("source_hash", "place", "hi", "lo")], axis=1)
    last = np.r_[(key[1:] != key[:-1]).any(axis=1), True] if len(key) else np.zeros(0, bool)
    return order[last]


# ---- the operator


def snapshot_changes(rows: DataFrame, source: list[str], snapshot: str, key: list[str], content: list[str], settings: DiffSettings = DiffSettings(), loaded: str | None = None) -> DataFrame:
    """Records added, removed or changed between each two consecutive deliveries of a source.

    A record is (source, snapshot, key); of several rows of a record the one with the latest ``loaded`` holds, among equally
    late ones the one whose content has the larger hash, and a null ``loaded`` counts as earliest. A delivery that has no
    rows does not exist; the first delivery of a source gives no rows. Returns source, snapshot (the later delivery), key and
    ``change``. Nulls: a null in ``content`` is a value of its own, a null in ``key`` or ``source`` too; a null ``snapshot``
    is no delivery and its rows are ignored. Input without rows gives no rows. Other columns of ``rows`` are ignored, and
    their names may clash with internal ones.
    """
    src, keys = [f"s{i}" for i in range(len(source))], [f"k{i}" for i in range(len(key))]
    # concat of tagged parts: a null and an empty text differ, and parts cannot run into each other
    tagged = lambda cols: [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cols]
    when = F.coalesce(F.unix_micros(F.col(loaded).cast("timestamp")), F.lit(-(1 << 63))) if loaded else F.lit(0).cast("long")
    base = rows.where(F.col(snapshot).isNotNull()).select(
        *[F.col(c).alias(n) for n, c in zip([*src, *keys], [*source, *key])], F.col(snapshot).alias("snapshot"), when.alias("loaded"), F.xxhash64(*tagged([F.col(c) for c in content]), F.lit("content")).alias("digest")
    )
    # deliveries are few per source; their sizes set the number of its buckets
    per_source = Window.partitionBy(*src)
    deliveries = rows.where(F.col(snapshot).isNotNull()).groupBy(*[F.col(c).alias(n) for n, c in zip(src, source)], F.col(snapshot).alias("snapshot")).agg(F.count(F.lit(1)).alias("n"))
    deliveries = deliveries.withColumns(
        {
            "place": F.row_number().over(per_source.orderBy("snapshot")),
            "following": F.lead("snapshot").over(per_source.orderBy("snapshot")),
            "buckets": F.greatest(F.ceil(F.sum("n").over(per_source) / settings.rows_per_bin), F.lit(1)),
        }
    ).drop("n")
    # written, so that its size is known when the join is planned; whether it is sent to all tasks is left to the planner
    deliveries = materialise(deliveries, "deliveries").select("*", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))).alias("salt"))
    bins = max(1, -(-rows.count() // settings.rows_per_bin))
    key_hash = F.xxhash64(*tagged([F.col(c) for c in keys]))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"d.{c}")) for c in [*src, "snapshot", "salt"]]
    salted = _combined(base, [*src, *keys, "snapshot", "digest"], "loaded").withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(settings.salts)).cast("int"))
    joined = salted.alias("b").join(deliveries.alias("d"), same).select("b.*", "d.place", "d.following", "d.buckets").drop("salt")
    bucket = F.pmod(key_hash, F.col("buckets"))
    binned = joined.withColumn("bin", F.pmod(F.xxhash64(*tagged([F.col(c) for c in src]), bucket), F.lit(bins))).drop("buckets").repartition("bin")
    hashed = binned.select("*", F.xxhash64(*tagged([F.col(c) for c in src])).alias("source_hash"), F.xxhash64(F.lit("hi"), *tagged([F.col(c) for c in keys])).alias("hi"), F.xxhash64(F.lit("lo"), *tagged([F.col(c) for c in keys]), F.lit("lo")).alias("lo"))
    out = StructType([hashed.schema[c] for c in [*src, "snapshot", *keys]])
    out = StructType([*out.fields, *_parse_datatype_string("change string").fields])
    arrow = to_arrow_schema(out)

    def change(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy().astype(np.int64) for c in ("source_hash", "place", "hi", "lo", "digest", "loaded")}
        kept = _latest(columns)
        _, number = np.unique(columns["source_hash"][kept], return_inverse=True)
        records = _Records(number.reshape(-1), columns["place"][kept], columns["hi"][kept], columns["lo"][kept], columns["digest"][kept], kept)
        goes_on = table.column("following").is_valid().to_numpy()[kept]
        pairs = np.concatenate([np.stack([records.source, records.place - 1], axis=1)[records.place > 1], np.stack([records.source, records.place], axis=1)[goes_on]])
        if not len(pairs):
            return arrow.empty_table()
        parts = list(_differences(records, np.unique(pairs, axis=0), settings))
        row, sign = np.concatenate([r for r, _ in parts]), np.concatenate([s for _, s in parts])
        # a record that comes and goes in one pair has changed: both halves have the pair and the key in common
        pair = columns["place"][row] - (sign > 0)
        order = np.lexsort([-sign, columns["lo"][row], columns["hi"][row], pair, columns["source_hash"][row]])
        row, sign, pair = row[order], sign[order], pair[order]
        key = np.stack([columns["source_hash"][row], pair, columns["hi"][row], columns["lo"][row]], axis=1)
        twin = np.r_[(key[1:] == key[:-1]).all(axis=1), False] if len(key) else np.zeros(0, bool)
        second = np.r_[False, twin[:-1]] if len(key) else twin
        kinds = np.where(twin, "changed", np.where(sign > 0, "added", "removed"))[~second]
        row, sign = row[~second], sign[~second]
        picked = table.take(pa.array(row))
        later = pa.compute.if_else(pa.array(sign > 0), picked.column("snapshot"), picked.column("following"))
        return pa.Table.from_arrays([*(picked.column(c) for c in src), later, *(picked.column(c) for c in keys), pa.array(kinds, type=pa.string())], names=arrow.names).cast(arrow)

    changes = hashed.groupBy("bin").applyInArrow(change, out)
    return changes.select(*[F.col(a).alias(b) for a, b in zip(src, source)], F.col("snapshot").alias(snapshot), *[F.col(a).alias(b) for a, b in zip(keys, key)], "change")


def _combined(rows: DataFrame, by: list[str], latest: str) -> DataFrame:
    """Rows that are equal in ``by`` as one with the latest time, within each batch of a task: a record that is delivered
    over and over shrinks before it is moved, and what is left of it is settled later."""
    names = rows.columns
    arrow = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grouped = pa.Table.from_batches([batch]).group_by(by, use_threads=False).aggregate([(latest, "max")]).rename_columns({f"{latest}_max": latest})
            yield from grouped.select(names).cast(arrow).to_batches()

    return rows.mapInArrow(run, rows.schema)
