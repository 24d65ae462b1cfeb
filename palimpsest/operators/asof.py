"""As-of joins with calendars of any size: each row meets the version of its key that was the latest to start by then.

Rows and version starts are sorted together by key and time, and the last start is carried down. A key with more than its share of rows is
cut into ranges of time at its own quantiles, so no task gets a whole hot key; what was in force at the end of a range is carried
over its border through one small row a range. Nothing is broadcast but the borders of hot keys, whose number is bounded. One
instant of one key is not divided.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.frames import importable, stored

#: A range holds one part in RANGES times the shuffle partitions of all rows at most, as far as quantiles tell; LEAST rows are never cut.
RANGES, LEAST = 4, 1000


def _limit(df: DataFrame, total: int) -> int:
    return max(LEAST, total // (RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def borders(rows: DataFrame, keys: list[str], at: str) -> DataFrame | None:
    """keys, _points: where to cut the times of each key with too many rows; None if no key has. There are as many such keys as a share
    fits into all rows, at most.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    most, total = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    limit = _limit(rows, total)
    if most <= limit:
        return None
    hot = sizes.where(F.col("n") > limit).select(*keys)
    cuts = min(1000, -(-most // limit))
    points = F.percentile_approx(at, [i / cuts for i in range(1, cuts)], 10 * cuts)
    cut = rows.join(F.broadcast(hot), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.array_distinct(points)).alias("_points"))
    return stored(cut, "borders")


def _ranged(rows: DataFrame, cut: DataFrame | None, keys: list[str], at: Column, name: str = "_range") -> DataFrame:
    """rows with the number of the range of its key that `at` is in; 0 for keys that aren't cut."""
    if cut is None:
        return rows.withColumn(name, F.lit(0))
    passed = F.size(F.filter("_points", lambda p: p <= at))
    return rows.join(F.broadcast(cut), keys, "left").withColumn(name, F.when(F.col("_points").isNull(), 0).otherwise(passed)).drop("_points")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, take: list[str]) -> DataFrame:
    """left with the columns `take` of the last row of right with the same keys whose `start` is at or before `at`; nulls where there is none.

    Of equal starts the row with the largest `take` is the last. Null keys and times meet nothing. left's columns must not be among `take`.
    """
    whole = " and ".join(f"`{c}` is not null" for c in (*keys, at))
    rows = left.where(whole).select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*(F.col(c) for c in left.columns)).alias("_row"), F.lit(None).alias("_take"))
    starts = right.where(" and ".join(f"`{c}` is not null" for c in (*keys, start)))
    starts = starts.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(start).alias("_from"), *take).alias("_take")).withColumn("_row", F.lit(None))
    both = rows.unionByName(starts)
    cut = borders(both.select(*keys, "_at"), keys, "_at")
    both = _ranged(both, cut, keys, F.col("_at"))
    order = Window.partitionBy(*keys, "_range").orderBy("_at", "_side", "_take").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_got", F.last("_take", True).over(order)).where("_side = 1")
    if cut is not None:
        last = _ranged(starts, cut, keys, F.col("_at")).join(F.broadcast(cut.select(*keys)), keys, "left_semi").groupBy(*keys, "_range").agg(F.max("_take").alias("_last"))
        grid = cut.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_points"))).alias("_range"))
        before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = grid.join(last, [*keys, "_range"], "left").withColumn("_carried", F.last("_last", True).over(before)).drop("_last")
        # A row for each range of a hot key: no more than RANGES times the partitions, or a thousand a hot key.
        found = found.join(F.broadcast(carried), [*keys, "_range"], "left").withColumn("_got", F.coalesce("_got", "_carried"))
    out = found.select("_row.*", *(F.col(f"_got.{c}").alias(c) for c in take))
    rest = left.where(f"not ({whole})")
    kinds = dict(out.dtypes)
    return out.unionByName(rest.select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in take)))


def _sweep(rows: list[tuple]) -> Iterator[tuple]:
    """(key, time, row number or None) wherever the winner changes, of rows (key, (range begin, range end), start, end or None, number), sorted by key and start;
    a range or window that is open on a side has None there.

    The open window that started last wins. Windows on the stack are in order of start, so an ended one is dropped when it comes up.
    """
    at = 0
    while at < len(rows):
        key, within = rows[at][:2]
        stack, now, shown = [], within[0], ()

        def advance(to, key=key, stack=stack):  # noqa: ANN001, ANN202
            nonlocal now, shown
            while True:
                while stack and stack[-1][0] is not None and stack[-1][0] <= now:
                    stack.pop()
                top = stack[-1] if stack else (None, None)
                if (top[1],) != shown:
                    shown = (top[1],)
                    yield key, now, top[1]
                if top[0] is None or (to is not None and top[0] >= to):
                    return
                now = top[0]

        while at < len(rows) and rows[at][:2] == (key, within):
            _, _, start, end, number = rows[at]
            at += 1
            if end is not None and end <= start:
                continue
            if now is None:
                now = start
            if start > now:
                yield from advance(start)
                now = start
            stack.append((end, number))
            if at < len(rows) and rows[at][:2] == (key, within) and rows[at][2] <= now:
                continue  # of windows that are open by now the last decides
        if now is not None:
            yield from advance(within[1])


def segments(windows: DataFrame, keys: list[str], start: str, end: str, take: list[str]) -> DataFrame:
    """keys, `start`, take: from when on which of the key's windows [start, end) is in force; take is null where none is.

    Windows may overlap: of those open at a time the one that started last is in force, and of equal starts the one of the largest
    `take`. A null end is open. The windows of a hot key are swept range by range; into a range come the windows that end in it and,
    of those that span it all, the one that started last, found over ranges of 1, 2, 4, ... so that a window is copied some
    twenty times at most.
    """
    rows = windows.where(" and ".join(f"`{c}` is not null" for c in (*keys, start))).select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"), F.struct(*take).alias("_take"))
    rows = stored(rows.where("_end is null or _end > _start"), "windows")
    cut = borders(rows, keys, "_start")
    own = _ranged(rows, cut, keys, F.col("_start"))
    if cut is not None:
        own = _ranged(own, cut, keys, F.col("_end"), "_ends")
        levels = 11  # ranges number a thousand at most
        hot = own.join(F.broadcast(cut), keys).withColumn("_ends", F.when(F.col("_end").isNull(), F.size("_points") + 1).otherwise(F.col("_ends")))
        ending = hot.where("_end is not null and _ends > _range").withColumn("_range", F.col("_ends"))
        node = lambda level, i: F.struct(level.alias("level"), i.cast("int").alias("node"))

        def nodes(level: Column) -> Column:
            low, high = F.call_function("shiftright", F.col("_range") + F.call_function("shiftleft", F.lit(1), level), level), F.call_function("shiftright", F.col("_ends"), level)
            return F.array(F.when((low < high) & (low % 2 == 1), node(level, low)), F.when((low < high) & (high % 2 == 1), node(level, high - 1)))

        spans = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), nodes)))
        best = hot.where(F.col("_ends") > F.col("_range") + 1).select(*keys, F.explode(spans).alias("_node"), F.struct("_start", "_take", "_end").alias("_w")).groupBy(*keys, "_node").agg(F.max("_w").alias("_w"))
        grid = cut.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_points"))).alias("_range"))
        seen = grid.withColumn("_node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda n: node(n, F.call_function("shiftright", F.col("_range"), n)))))
        spanning = seen.join(best, [*keys, "_node"]).groupBy(*keys, "_range").agg(F.max("_w").alias("_w")).select(*keys, "_range", "_w.*")
        cols = [*keys, "_start", "_end", "_take", "_range"]
        # A range that no window starts or ends in still has a state at its border.
        empty = grid.select(*keys, *(F.lit(None).cast(dict(own.dtypes)[c]).alias(c) for c in ("_start", "_end", "_take")), "_range")
        own = own.select(cols).unionByName(ending.select(cols)).unionByName(spanning.select(cols)).unionByName(empty)
        begin = F.when(F.col("_range") > 0, F.get("_points", F.col("_range") - 1))
        own = own.join(F.broadcast(cut), keys, "left").withColumns({"_begin": begin, "_until": F.get("_points", "_range")}).drop("_points")
    else:
        own = own.withColumns(dict.fromkeys(("_begin", "_until"), F.lit(None).cast(dict(rows.dtypes)["_start"])))
    names = [*keys, "_at", "_take"]
    kinds = dict(own.dtypes)

    def sweep(table: pa.Table) -> pa.Table:
        table = table.sort_by([*((k, "ascending") for k in keys), ("_range", "ascending"), ("_start", "ascending"), ("_order", "ascending")])
        key = list(zip(*(table.column(k).to_pylist() for k in (*keys, "_range")), strict=True))
        begin, until, start, end = ((table.column(c).cast(pa.int64()) if pa.types.is_temporal(table.column(c).type) else table.column(c)).to_pylist() for c in ("_begin", "_until", "_start", "_end"))
        rows, first, state = [], {}, set()
        for i, k in enumerate(key):
            first.setdefault(k, i)
            if start[i] is not None:
                rows.append((k, (begin[i], until[i]), start[i], end[i], i))
            else:
                state.add((k, begin[i]))
        found = list(_sweep(rows))
        swept = {k for k, _, _ in found}
        found += [(k, b, None) for k, b in state if k not in swept and b is not None]
        place = pa.array([first[k] for k, _, _ in found], pa.int64())
        number = pa.array([n for _, _, n in found], pa.int64())
        kind = table.column("_start").type
        at = pa.array([t for _, t, _ in found], pa.int64() if pa.types.is_temporal(kind) else kind).cast(kind)
        return pa.table([*(table.column(k).take(place) for k in keys), at, table.column("_take").take(number)], names=names)

    n_groups = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    importable(rows.sparkSession)
    # Of equal starts the largest `take` comes last; its place is found here, as Arrow doesn't sort by structs.
    ordered = own.withColumn("_order", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_start", "_take")))
    dealt = ordered.withColumn("_group", F.pmod(F.xxhash64(*keys, "_range"), F.lit(n_groups)))
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"_at {kinds['_start']}", f"_take {kinds['_take']}"])
    out = dealt.groupBy("_group").applyInArrow(lambda t: sweep(t), schema)
    return out.select(*keys, F.col("_at").alias(start), "_take.*")


def in_force(left: DataFrame, windows: DataFrame, keys: list[str], at: str, start: str, end: str, take: list[str]) -> DataFrame:
    """left with the columns `take` of its key's window that is in force at `at`; see `segments` for windows that overlap."""
    return asof(left, segments(windows, keys, start, end, take), keys, at, start, take)
