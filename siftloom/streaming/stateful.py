"""Ledgers as streams with state of their own: ids with a time to live from the first sight, and deferral as a state machine.

State is kept by key in the state store (RocksDB on a cluster), and timers on event time remove what has run out. An id's rows are taken in the order
of their days whatever micro-batches they come in, as long as earlier days come in no later batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from siftloom.operators.ledger import DEFER_DAYS, ROUNDS, SEEN_DAYS

DAY_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _seen_processor(keep: int):
    class Seen(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.first = handle.getValueState("first", "day int")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            days = sorted({int(d) for part in rows for d in part["day"].unique()})
            held = self.first.get()
            first, fresh = (None if held is None else int(held[0])), []
            for day in days:
                # an id is known to the run of a day if the ledger that the run before left has it
                if first is None or day - 1 - first > keep:
                    first = day
                    fresh.append(day)
            if fresh:
                self.first.update((first,))
                self.handle.registerTimer((first + keep + 2) * DAY_MS)
                yield pd.DataFrame({"id": [key[0]] * len(fresh), "day": pd.Series(fresh, dtype="int32")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            held = self.first.get()
            if held is not None and (int(held[0]) + keep + 2) * DAY_MS <= expiredTimerInfo.getExpiryTimeInMs():
                self.first.clear()
            yield from ()

        def close(self) -> None:
            pass

    return Seen()


def first_sights(items: DataFrame, at: str = "at", keep: int = SEEN_DAYS) -> DataFrame:
    """(id, first_date) of each first sight: an id counts as new again once the ledger of the run before has let it go, keep days after its first sight.

    Equals a daily save_seen of the ids that the ledger of the run before doesn't have. items: id (text) and an instant, whose UTC day is that of
    the run. State: a day for each id that was seen in the last keep + 2 days; a timer removes it.
    """
    rows = items.select(F.col("id").cast("string").alias("id"), F.col(at).alias("at"), F.expr(f"cast(floor(unix_micros({at}) / 86400000000) as int)").alias("day"))
    found = rows.withWatermark("at", "0 seconds").groupBy("id").transformWithStateInPandas(_seen_processor(keep), "id string, day int", "Append", "EventTime")
    return found.select("id", F.date_from_unix_date("day").alias("first_date"))


def _deferral_processor(rounds: int, ttl: int):
    class Deferral(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.entry = handle.getValueState("entry", "state string, first int, last int, attempts int, stalls int, promoted boolean, stalled boolean")
            self.gates = handle.getMapState("gates", "gate string", "n int")

        def ends(self, first: int, last: int) -> int:
            """The first day on which an entry goes if its id doesn't come."""
            return max(first + ttl + 1, last + 1)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            days = pd.concat(list(rows))[["day", "gate", "muted"]].sort_values("day").itertuples(index=False)  # a row for each day
            held = self.entry.get()
            entry = None if held is None else list(held)
            gates = {k[0]: v[0] for k, v in self.gates.iterator()} if entry else {}
            for day, gate, muted in days:
                day = int(day)
                if entry is not None and entry[0] == "seen":
                    break
                if entry is not None and day > self.ends(entry[1], entry[2]):
                    entry, gates = None, {}
                _, first, _, attempts, stalls, _, _ = entry or (None, day, day, 0, 0, False, False)
                gated = isinstance(gate, str)
                stall = gated and gate == "thin" and bool(muted) and first >= day - ttl
                attempts, stalls = attempts + (gated and not stall), stalls + stall
                if gated:
                    gates[gate] = gates.get(gate, 0) + 1
                done = not gated or (not stall and attempts >= rounds)
                entry = ["seen" if done else "wait", first, day, attempts, stalls, done and gated, stall]
            self.entry.update(tuple(entry))
            self.gates.clear()
            for g, n in gates.items():
                self.gates.updateValue((g,), (n,))
            if entry[0] == "wait":
                self.handle.registerTimer((self.ends(entry[1], entry[2]) + 1) * DAY_MS)
            yield self.row(key[0], entry, gates)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            held = self.entry.get()
            if held is not None and held[0] == "wait" and (self.ends(held[1], held[2]) + 1) * DAY_MS <= expiredTimerInfo.getExpiryTimeInMs():
                gates = {k[0]: v[0] for k, v in self.gates.iterator()}
                self.entry.clear()
                self.gates.clear()
                yield self.row(key[0], ["expired", *held[1:]], gates)

        def row(self, id_, entry, gates) -> pd.DataFrame:
            names = ["id", "state", "first", "last", "attempts", "stalls", "promoted", "stalled", "gates"]
            text = ",".join(f"{g}={gates[g]}" for g in sorted(gates))
            return pd.DataFrame([[id_, *entry, text]], columns=names)

        def close(self) -> None:
            pass

    return Deferral()


def deferrals(runs: DataFrame, at: str = "at", rounds: int = ROUNDS, ttl: int = DEFER_DAYS) -> DataFrame:
    """A row for each id and micro-batch it came in, and one when its entry runs out: id, state (seen, wait or expired), first, last, attempts, stalls,
    gates (gate=n, by name), promoted, stalled. The last row of an id is what the daily plans would have left.

    runs: id (text), an instant of the run's UTC day, gate, muted; a row for each id and day. State: the entry of each id, and a map of its gates.
    """
    rows = runs.select(F.col("id").cast("string").alias("id"), F.col(at).alias("at"), F.expr(f"cast(floor(unix_micros({at}) / 86400000000) as int)").alias("day"), "gate", "muted")
    schema = "id string, state string, first int, last int, attempts int, stalls int, promoted boolean, stalled boolean, gates string"
    found = rows.withWatermark("at", "0 seconds").groupBy("id").transformWithStateInPandas(_deferral_processor(rounds, ttl), schema, "Update", "EventTime")
    return found.withColumns({c: F.date_from_unix_date(c) for c in ("first", "last")})


def run_in_periods(arrivals: list[DataFrame], operator: Callable[[DataFrame], DataFrame], path: str, mode: str = "append") -> DataFrame:
    """What an operator on a stream gives when tables land under path one after the other: its rows with the batch they came in.

    Each arrival is a run of its own that takes what is new and stops (availableNow), and begins from the checkpoint that the run before
    left. A batch that is run again replaces what it had written.
    """
    spark = arrivals[0].sparkSession
    provider, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    spark.conf.set(provider, ROCKSDB)  # the one that has timers and maps
    try:
        for rows in arrivals:
            rows.write.mode("append").parquet(f"{path}/in")
            landed = spark.readStream.schema(arrivals[0].schema).parquet(f"{path}/in")
            operator(landed).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{path}/out")
