"""First and last of each key, keepers of equal files, names that don't collide, chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered, numbered_within
from .tables import lasting


def first_wins(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key, by explicit order columns. Minima are combined before the shuffle, so a hot key costs no more than others."""
    return _one(df, key, order, F.min)


def last_wins(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return _one(df, key, order, F.max)


def _one(df: DataFrame, key: list[Column], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in order]
    keys = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    row = pick(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*(F.col("_row")[c].alias(c) for c in df.columns))


def with_copies(df: DataFrame, size: str) -> DataFrame:
    """A3: dup_count, how many rows share a size; a size of 0 counts as one of its own. Counted before the join."""
    n = df.where(F.col(size) > 0).groupBy(F.col(size).alias("_size")).agg(F.count("*").alias("dup_count"))
    return df.join(n, F.col(size) == F.col("_size"), "left").drop("_size").withColumn("dup_count", F.coalesce("dup_count", F.lit(1)))


def size_groups(df: DataFrame, size: str, path: str) -> DataFrame:
    """A4: sizes that two or more rows share, with what could be recovered."""
    g = df.where(F.col(size) > 0).groupBy(size).agg(F.count("*").alias("n"), F.min(path).alias("first"))
    return g.where("n > 1").withColumn("recoverable", F.col(size) * (F.col("n") - 1))


def hashed(df: DataFrame, size: str, content: str, name: str = "hash") -> DataFrame:
    """df without its contents, with their SHA-1 where another row has the same size, else null.

    As long as the shared sizes are few enough for a broadcast, only those rows are hashed; beyond that all are, before
    anything is shuffled: contents never travel.
    """
    from .matching import BROADCAST_ROWS

    shared = df.groupBy(F.col(size).alias("_size")).agg(F.count("*").alias("_n")).where("_n > 1").select("_size")
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met, own = df.join(F.broadcast(shared), F.col(size) == F.col("_size"), "left"), F.sha1(F.col(content))
    else:
        met, own = df.withColumn("_sha", F.sha1(F.col(content))).drop(content).join(shared, F.col(size) == F.col("_size"), "left"), F.col("_sha")
    return met.withColumn(name, F.when(F.col("_size").isNotNull(), own)).drop("_size", "_sha", content)


def keepers(rows: DataFrame, size: str, name: str, hash_: str = "hash") -> DataFrame:
    """W3 of hashed() rows: size, hash, keep, n, redundant, wasted; keeper by fewest copy marks, shortest name, name."""
    low = F.lower(F.col(name))
    marks = lambda w: (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
    best = F.min(F.struct((marks("copie") + marks("copy")).alias("marks"), F.length(name).alias("n"), F.col(name).alias("name")))
    g = rows.where(F.col(hash_).isNotNull()).groupBy(F.col(size), F.col(hash_).alias("hash")).agg(best["name"].alias("keep"), F.count("*").alias("n")).where("n > 1")
    return g.withColumn("redundant", F.col("n") - 1).withColumn("wasted", F.col(size) * (F.col("n") - 1))


def equal_files(df: DataFrame, size: str, content: str, name: str) -> DataFrame:
    """Groups of equal content."""
    return keepers(hashed(df.select(size, content, name), size, content), size, name)


#: What a name that was taken gets before its extension. Only such numbers can be in the way of others.
_NUMBERS = r"((?: \([1-9]\d{0,17}\))*)$"
_LAST = r"(?s)^(.*) \(([1-9]\d{0,17})\)$"
_BASE = ["folder", "stem", "ext"]


def _parts(name: Column) -> tuple[Column, Column]:
    """Stem and extension; a name that begins with its only dot has no extension."""
    return F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)


def _base(folder: str, name: Column) -> list[Column]:
    stem, ext = _parts(F.lower(name))
    return [F.col(folder).alias("folder"), stem.alias("stem"), ext.alias("ext")]


def _family(stem: Column) -> Column:
    """The stem without all its numbers."""
    return F.regexp_replace(stem, _NUMBERS, "")


def _held(names: DataFrame, at: Column) -> DataFrame:
    """Names (folder, stem, ext) as numbers that are in the way of a base: 0 of their own, and the last number of their stem without it."""
    own = names.select(*_BASE, F.lit(0).cast("long").alias("n"), at.alias("at"))
    less = names.where(F.col("stem").rlike(_LAST)).select("folder", F.regexp_extract("stem", _LAST, 1).alias("stem"), "ext", F.regexp_extract("stem", _LAST, 2).cast("long").alias("n"), at.alias("at"))
    return own.unionByName(less)


def _free_numbers(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The number that each file of a base gets.

    rows, sorted: base, place, kind (0: a number that is held, 1: a file), at, own, id. A held number stands at itself and a file at
    its rank, so that what decides about a file is near it. Files come in order of time; each takes the smallest number that
    no earlier one took and that isn't held at its time, or its own number, which is held for all others, if that is smaller.
    A number that was passed over stays passed over.
    """
    base, least, held, waiting = None, 0, deque(), deque()

    def resolve(known: float) -> Iterator[tuple]:
        """Files that numbers up to `known` decide."""
        nonlocal least
        while waiting:
            at, own, id_ = waiting[0]
            while least <= known:
                while held and held[0][1] < least:
                    held.popleft()
                first = next((h for h in held if h[0] <= least <= h[1] and h[2] < at), None) if held and held[0][0] <= least else None
                if first is None:
                    break
                least += 1 if first[2] >= 0 else first[1] + 1 - least
            if own is not None and own < least:
                number = own
            elif least <= known:
                number, least = least, least + 1
            else:
                return
            waiting.popleft()
            yield base, at, id_, number

    for key, place, kind, at, own, id_ in rows:
        if key != base:
            yield from resolve(float("inf"))
            base, least = key, 0
            held.clear()
        if kind:
            waiting.append((at, own, id_))
            yield from resolve(place)
        else:
            yield from resolve(place - 1)
            if place >= least:
                if at < 0 and held and held[-1][2] < 0 and held[-1][1] + 1 == place:
                    held[-1] = (held[-1][0], place, at)  # names that are there already, one after the other
                else:
                    held.append((place, place, at))
    yield from resolve(float("inf"))


def _assigned(rows: DataFrame) -> DataFrame:
    """_free_numbers() over rows dealt and sorted by base; only what waits for a decision is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                c = [b.column(i).to_pylist() for i in range(b.num_columns)]
                yield from zip(zip(c[0], c[1], c[2], strict=True), *c[3:], strict=True)

        found = _free_numbers(each())
        while some := list(islice(found, 4096)):
            columns = [[r[0][0] for r in some], [r[0][1] for r in some], [r[0][2] for r in some], *([r[i] for r in some] for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[*_BASE, "at", "id", "number"])

    dealt = rows.select(*_BASE, "place", "kind", "at", "own", "id").repartition(*_BASE).sortWithinPartitions(*_BASE, "place", "kind")
    return dealt.mapInArrow(run, "folder string, stem string, ext string, at long, id long, number long")


def unique_targets(df: DataFrame, folder: str, name: str, order: str, taken: DataFrame | None = None, own: str | None = None) -> DataFrame:
    """Rows of a folder take the first free name in order: a name, then with (1), (2), ...; case is ignored. Adds target.

    taken: names that are there already (folder, name), free for nobody but the file that has it; own: a column with the
    name that a row's file has in that folder now, or null. Null folders are one folder.

    Names only meet names that are the same without their numbers (a family). In a family without numbers in its names and
    without taken names a row's number is its rank. The others are worked through base by base (a name without number, then
    its numbered names, as a base may take what is the plain name of one below it), each as one sorted stream.
    """
    columns = df.columns
    stem, ext = _parts(F.lower(F.col(name)))
    folder_ = F.col(folder).cast("string")
    named = df.withColumns({"_stem": stem, "_ext": ext, "_family": _family(stem)})
    there = [taken.select("folder", "name")] if taken is not None else []
    if own is not None:
        there.append(df.where(F.col(own).isNotNull()).select(folder_.alias("folder"), F.col(own).alias("name")))
    held = None
    for t in there:
        held = t if held is None else held.unionByName(t)
    if held is not None:
        held = held.select(*_base("folder", F.col("name"))).distinct()
    odd = named.where(F.col("_stem") != F.col("_family")).select(folder_.alias("_of"), F.col("_family").alias("_os"), F.col("_ext").alias("_oe"))
    if held is not None:
        odd = odd.unionByName(held.select(F.col("folder").alias("_of"), _family(F.col("stem")).alias("_os"), F.col("ext").alias("_oe")))
    odd = odd.distinct()
    met = folder_.eqNullSafe(F.col("_of")) & (F.col("_family") == F.col("_os")) & (F.col("_ext") == F.col("_oe"))
    marked = named.join(odd, met, "left").withColumn("_odd", F.col("_os").isNotNull()).drop("_of", "_os", "_oe")
    ranked = numbered_within(marked, [folder, "_stem", "_ext"], order, "_rank")

    at, after = _parts(F.col(name))

    def with_target(rows: DataFrame, n: Column) -> DataFrame:
        return rows.withColumn("target", F.when(n == 0, F.col(name)).otherwise(F.concat(at, F.lit(" ("), n.cast("string"), F.lit(")"), after))).select(*columns, "target")

    plain = with_target(ranked.where(~F.col("_odd")), F.col("_rank"))
    depth = F.regexp_count(F.regexp_extract("_stem", _NUMBERS, 1), F.lit(r" \("))
    deepest = ranked.where("_odd").agg(F.max(depth)).first()[0]
    if deepest is None:
        return plain
    timed = lasting(numbered(ranked.where("_odd"), [order], "_t"))
    mine = F.lit(None).cast("long")
    if own is not None:
        own_stem, own_ext = _parts(F.lower(F.col(own)))
        numbered_ = F.when(F.regexp_extract(own_stem, _LAST, 1) == F.col("_stem"), F.regexp_extract(own_stem, _LAST, 2))
        mine = F.when(own_ext == F.col("_ext"), F.when(own_stem == F.col("_stem"), F.lit(0).cast("long")).otherwise(numbered_.try_cast("long")))
    files = timed.select(folder_.alias("folder"), F.col("_stem").alias("stem"), F.col("_ext").alias("ext"), F.col("_rank").alias("place"), F.lit(1).alias("kind"), F.col("_t").alias("at"), mine.alias("own"), F.col("_t").alias("id"), depth.alias("_depth"))
    first = files.groupBy(*_BASE).agg(F.min("at").alias("at"))
    in_way = _held(first, F.col("at")).where("n > 0")
    if held is not None:
        in_way = in_way.unionByName(_held(held, F.lit(-1).cast("long")))
    none = F.lit(None).cast("long")
    as_rows = lambda b: b.select(*_BASE, F.col("n").alias("place"), F.lit(0).alias("kind"), "at", none.alias("own"), none.alias("id"))
    blocks, done = as_rows(in_way), None
    for d in range(deepest + 1):
        level = files.where(F.col("_depth") == d).drop("_depth").unionByName(blocks)
        if done is not None:  # what the bases above took
            took = done.where("number > 0").select("folder", F.concat("stem", F.lit(" ("), F.col("number").cast("string"), F.lit(")")).alias("stem"), "ext", F.lit(0).cast("long").alias("n"), "at")
            level = level.unionByName(as_rows(took))
        now = lasting(_assigned(level))
        done = now if done is None else done.unionByName(now)
    numbers = done.select(F.col("id").alias("_id"), "number")
    return plain.unionByName(with_target(timed.join(numbers, F.col("_t") == F.col("_id")), F.col("number")))


def chunks(df: DataFrame, order: list[str], size: int = 25) -> DataFrame:
    """Chunk numbers from 1 of rows in order (columns that tell rows apart), without bringing all rows to one task."""
    return numbered(df, order, "_number").withColumn("chunk", (F.floor(F.col("_number") / size) + 1).cast("long")).drop("_number")
