"""Attribute limits on a stream of whole rows: spans, metric points, logs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.operators.sampling import HIGH_CARDINALITY

#: Places over which rows without their attributes are dealt on their way through the first stage.
SALTS = 32


class _Limit(StatefulProcessor):
    """Remembers the first values of one service's attribute; later new ones become the marker.  Pieces without a key pass."""

    def __init__(self, limit: int, columns: list[str], order: list[str]):
        self.limit, self.columns, self.order = limit, columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "value string", "at int")
        self.size = handle.getValueState("size", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[1] is None or key[1] != key[1]:
            for batch in rows:
                yield batch[self.columns]
            return
        # a trigger's rows of one key, in the order of their arrival
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        n = first = self.size.get()[0] if self.size.exists() else 0
        known: dict[Any, bool] = {}
        out = []
        for v, limited in zip(batch["value"], batch["limited"]):
            if not limited:
                out.append(v)
                continue
            if v not in known:
                known[v] = self.values.containsKey((v,))
            if not known[v] and n < self.limit:
                self.values.updateValue((v,), (n,))
                known[v], n = True, n + 1
            out.append(v if known[v] else HIGH_CARDINALITY)
        if n > first:
            self.size.update((n,))
        yield batch.assign(value=out)[self.columns]

    def close(self) -> None:
        pass


class _Gather(StatefulProcessor):
    """Puts a row's pieces together again.  They come in one trigger as a rule; what comes earlier than the last one waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "key string, value string, rest string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        n = int(batch["n"].iloc[0])
        plain = lambda c: [None if x is None or x != x else x for x in batch[c]]
        pieces = list(zip(plain("key"), plain("value"), plain("rest")))
        if len(pieces) < n:
            if self.waiting.exists():
                pieces = [tuple(p) for p in self.waiting.get()] + pieces
                self.waiting.clear()
            if len(pieces) < n:
                self.waiting.put(pieces)
                return
        rest = next(r for k, _, r in pieces if k is None)
        yield pd.DataFrame({"rest": [rest], "bag": [{k: v for k, v, _ in pieces if k is not None}]})

    def close(self) -> None:
        pass


def limit_bags(stream: DataFrame, bag: str, row: list[str], arrival: list[str], limit: int = 200, service: str = "service_name", types: str | None = None) -> DataFrame:
    """The stream's rows with attribute bags in which, by service and key, the first ``limit`` distinct values stay and later
    ones become a marker; the values known live as long as the query.  Within a trigger values arrive in the order of
    ``arrival``.  row: columns that together tell rows apart.  types: a map from keys to value types, of which only ``string`` is limited.

    Two keyed stages: a row's attributes go to the state of their service and key, and come together again by row.  The
    rest of a row travels as JSON beside them, a null bag stays null.  Needs the RocksDB state store.
    """
    others = [c for c in stream.columns if c != bag]
    order = [f"at{k}" for k in range(len(arrival))]
    limited = (lambda k: F.coalesce(F.try_element_at(F.col(types), k) == "string", F.lit(False))) if types else (lambda k: F.lit(True))
    none = F.lit(None).cast("string")
    each = F.transform(F.map_entries(bag), lambda e: F.struct(e.key.alias("key"), e.value.alias("value"), limited(e.key).alias("limited"), none.alias("rest")))
    rest = F.to_json(F.struct(*others, F.col(bag).isNull().alias("_no_bag")))
    whole = F.array(F.struct(none.alias("key"), none.alias("value"), F.lit(False).alias("limited"), rest.alias("rest")))
    df = stream.select(
        F.col(service).alias("service"), F.to_json(F.struct(*row)).alias("row"), *[F.col(c).alias(a) for c, a in zip(arrival, order)],
        F.concat(F.coalesce(each, F.array().cast("array<struct<key:string,value:string,limited:boolean,rest:string>>")), whole).alias("pieces"),
    )
    df = df.withColumn("n", F.size("pieces")).withColumn("p", F.explode("pieces")).select("service", "row", *order, "n", "p.*")
    df = df.withColumn("salt", F.when(F.col("key").isNull(), F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(0).cast("int"))
    piece = "row string, n int, key string, value string, rest string"
    columns = [c.split()[0] for c in piece.split(", ")]
    marked = df.groupBy("service", "key", "salt").transformWithStateInPandas(_Limit(limit, columns, order), outputStructType=piece, outputMode="Append", timeMode="None")
    whole = marked.groupBy("row").transformWithStateInPandas(_Gather(), outputStructType="rest string, bag map<string,string>", outputMode="Append", timeMode="None")
    # ALLOW_NON_NUMERIC_NUMBERS is on by default, so doubles come back as they went
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.drop(bag).schema.fields)
    out = whole.select(F.from_json("rest", f"{schema}, _no_bag boolean").alias("r"), "bag")
    return out.select(*[F.when(F.col("r._no_bag"), F.lit(None)).otherwise(F.col("bag")).alias(bag) if c == bag else F.col(f"r.{c}").alias(c) for c in stream.columns])
