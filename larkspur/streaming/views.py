"""Materialized views: a query that runs on each insert and writes to a target table.

A view is a Structured Streaming query over a folder of parquet files. It never sees history; a
backfill does, window by window, with a ledger of windows that are done.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.errors import QueryBuilderDefect
from larkspur.operators.store import Store
from larkspur.plans.lower import Context, lower
from larkspur.plans.query import Query, Source, Union
from larkspur.table import TableDef


@dataclass(frozen=True)
class MaterializedView:
    name: str
    to: TableDef
    body: Query

    def over(self, rows: DataFrame) -> DataFrame:
        """The body over these rows in place of its source."""
        source = self.body.source
        table = replace(source.of, source=lambda spark: rows)
        return lower(replace(self.body, source=Source(table, source.alias)), Context(rows.sparkSession))

    def start(self, store: Store, folder: str, checkpoint: str, once: bool = False) -> Any:
        """Follow the folder of the body's source; each batch of new files appends to the target, once.

        A batch that is tried again after its rows were written finds its number in the target's pointer.
        """
        spark, source = store.spark, self.body.source.of
        incoming = spark.readStream.schema(source.schema()).parquet(folder)

        key = f"stream {self.name} {checkpoint}"

        def write(batch: DataFrame, epoch: int) -> None:
            if epoch > store.marks(self.to).get(key, -1):
                store.append(self.to, self.over(batch), {key: epoch})

        writer = incoming.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(self.name)
        return (writer.trigger(availableNow=True) if once else writer).start()


def materialized_view(name: str, to: TableDef, body: Query | Union) -> MaterializedView:
    if isinstance(body, Union) or body.source is None or not isinstance(body.source.of, TableDef):
        raise QueryBuilderDefect("a view reads one table first")
    outputs = body.outputs()
    missing = set(outputs) - set(to.columns)
    if missing:
        raise QueryBuilderDefect(f"{to.name} has no column {sorted(missing)[0]}")
    for n, e in outputs.items():
        if e.type is not None and e.type.spark != to.columns[n].spark and {e.type.spark.typeName(), to.columns[n].spark.typeName()} - {"byte", "short", "integer", "long", "double", "float"}:
            raise QueryBuilderDefect(f"{n} is {e.type.name}, not {to.columns[n].name}")
    return MaterializedView(name, to, body)


#: How rows of one key merge, by a column's merge function.
MERGES: dict[str, Callable] = {"sum": F.sum, "min": F.min, "max": F.max, "any": F.first, "anyLast": F.last, "argMax": F.max, "argMin": F.min}


def merged(df: DataFrame, table: TableDef, version: str | None = None) -> DataFrame:
    """A view's rows as its engine reads them: one row per ordering key.

    'summing' adds numbers up, 'aggregating' uses the columns' merge functions, 'replacing' keeps
    the row of the greatest version.
    """
    keys = list(table.order_by)
    if table.engine == "plain" or not keys:
        return df
    rest = [n for n in table.columns if n not in keys]
    if table.engine == "replacing":
        by = F.struct(*([version] if version else []), *[n for n in rest if n != version])
        return df.groupBy(*keys).agg(F.max(by).alias("__row")).select(*[F.col(n) if n in keys else F.col(f"__row.{n}").alias(n) for n in table.columns])
    numeric = {"byte", "short", "integer", "long", "float", "double", "decimal"}
    aggs = []
    for n in rest:
        kind = table.columns[n]
        fn = MERGES[kind.merge] if kind.merge else F.sum if table.engine == "summing" and kind.spark.typeName() in numeric else F.first
        aggs.append(fn(n).cast(kind.spark).alias(n))
    return df.groupBy(*keys).agg(*aggs).select(*table.columns)


def compact(store: Store, table: TableDef, version: str | None = None) -> None:
    store.overwrite(table, merged(store.frame(table), table, version))


DAY = 86_400


def backfill(view: MaterializedView, store: Store, rows: DataFrame, column: str, since: dt.datetime, until: dt.datetime, days: int = 1) -> int:
    """Append the body over [since, until), in windows of whole days counted from 1970; done windows are skipped."""
    ledger = f"backfill {view.name}"
    done = set(store.marks(view.to).get(ledger, []))
    width, began = days * DAY, 0
    at = int(since.replace(tzinfo=dt.UTC).timestamp())
    end = int(until.replace(tzinfo=dt.UTC).timestamp())
    while at < end:
        stop = min(end, (at // width + 1) * width)
        key = f"{at}-{stop}"
        if key not in done:
            lo, hi = (dt.datetime.fromtimestamp(x, dt.UTC).replace(tzinfo=None) for x in (at, stop))
            done.add(key)
            store.append(view.to, view.over(rows.where((F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi)))), {ledger: sorted(done)})
            began += 1
        at = stop
    return began


def tumbling(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], *aggs: Any) -> DataFrame:
    """Watermarked tumbling windows over a stream: an extension."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(*aggs)


