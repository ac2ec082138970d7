"""Admission under quotas as a stateful stream: what a band has accepted is kept in state, so a restarted query goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor(quotas: dict[str, int], default: int, band: str, key: str, place: str) -> StatefulProcessor:
    """The processor of a band; a class of this function, so that workers that do not have this package get its code."""

    class Admission(StatefulProcessor):
        """State of a band: the number of accepted keys, and the keys with their places; both are bounded by its quota."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.count = handle.getValueState("count", "n long")
            self.seen = handle.getMapState("seen", "key string", "place long")

        def handleInputRows(self, of, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            taken = self.count.get()[0] if self.count.exists() else 0
            left = quotas.get(of[0], default) - taken
            known = {k[0] for k in self.seen.keys()} if left > 0 else set()
            first: dict[str, int] = {}
            for part in rows:  # of the new keys only the first ``left`` by place can be accepted
                if left <= 0:
                    continue
                fresh = part[~part[key].isin(known)].groupby(key)[place].min()
                for k, p in fresh.items():
                    first[k] = min(p, first.get(k, p))
                if len(first) > left:
                    first = dict(sorted(first.items(), key=lambda x: x[1])[:left])
            accepted = sorted(first.items(), key=lambda x: x[1])
            for k, p in accepted:
                self.seen.updateValue((k,), (int(p),))
            if accepted:
                self.count.update((taken + len(accepted),))
                yield pd.DataFrame([(of[0], k, int(p), taken + i + 1) for i, (k, p) in enumerate(accepted)], columns=[band, key, place, "ordinal"])

        def close(self) -> None:
            pass

    return Admission()


def admitted(stream: DataFrame, quotas: dict[str, int], band: str = "band", key: str = "alpha_hash", place: str = "seed", default: int = 0) -> DataFrame:
    """(band, key, place, ordinal) of each band's accepted keys, as they are accepted.

    A band takes the first ``quotas[band]`` (else ``default``) different keys
    in the order of micro-batches, within one by ``place``; a key counts in
    each band by itself, null as the text "null".  Memory and state of a band
    depend on its quota, not on its rows.
    """
    rows = stream.selectExpr(f"`{band}`", f"coalesce(cast(`{key}` as string), 'null') as `{key}`", f"cast(`{place}` as long) as `{place}`")
    kind = rows.schema[band].dataType.simpleString()
    made = f"`{band}` {kind}, `{key}` string, `{place}` long, ordinal long"
    return rows.groupBy(band).transformWithStateInPandas(_processor(quotas, default, band, key, place), made, "Append", "None")


def run(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process all that is there, with the state store that such operators need, and stop; the next call goes on from the checkpoint."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    finally:
        spark.conf.set(STORE, before)
