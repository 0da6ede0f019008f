"""Operators that keep state across micro-batches: the same results as their batch forms.

State is keyed by what the batch form partitions by (a change's position, a
transaction), so it spreads over executors and ends with its key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import COMMIT, DATA
from ..operators.pairing import CHANGE_OPS, DELETE, INSERT, UPDATE_AFTER, UPDATE_BEFORE


def pair_updates(changes: DataFrame, keys: Sequence[str] = ("commit_lsn", "change_lsn")) -> DataFrame:
    """Change-table rows (``keys``, operation, image) to changes; an update's first half waits for its second.

    An after row without its before row is an error, as the order of a change table does not allow it.
    """

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("operation")
        held, out = state.get[0] if state.exists else None, []
        for operation, image in zip(rows["operation"], rows["image"], strict=True):
            if operation == UPDATE_BEFORE:
                held = image
            elif operation == UPDATE_AFTER:
                if held is None:
                    raise ValueError(f"an update's after row came without its before row: {key}")
                out.append((*key, "u", UPDATE_AFTER, held, image))
                held = None
            elif operation == DELETE:
                out.append((*key, "d", DELETE, image, None))
            elif operation == INSERT:
                out.append((*key, "c", INSERT, None, image))
            else:
                raise ValueError(f"unknown operation: {operation}")
        if held is not None:
            state.update((held,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[*keys, "op", "serial", "before", "after"])

    assert set(CHANGE_OPS) == {DELETE, INSERT, UPDATE_AFTER}
    keys = list(keys)
    paired = ", ".join([*(f"`{k}` {changes.schema[k].dataType.simpleString()}" for k in keys), "op string, serial bigint, before string, after string"])
    return changes.groupBy(*keys).applyInPandasWithState(pair, paired, "held string", "append", GroupStateTimeout.NoTimeout)


def binlog(entries: DataFrame, arrival: str = "arrival") -> DataFrame:
    """What ``sources.logs.decode_binlog`` gives, for a stream: a server's open transaction and table map wait in state between batches."""
    names = entries.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gtid, tx, anchor, file, serial = state.get if state.exists else (None, "", None, None, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values(arrival).itertuples(index=False):
            op, end = {"write": "c", "update": "u", "delete": "d"}.get(r.kind), r.kind == "xid" or (r.kind == "query" and r.word in ("COMMIT", "ROLLBACK"))
            if r.kind == "gtid" or (r.kind == "query" and r.word == "BEGIN"):
                gtid = r.gtid
                tx = gtid or f"{r.file}:{r.pos}"
            elif r.kind == "table_map":
                anchor, file, serial = r.pos, r.file, 0
            elif op:
                file, serial = r.file, serial + 1 if r.file == file else 1
                out.append((r.row, op, DATA, tx, gtid, anchor, str(serial)))
            if end:
                out.append((r.row, None, COMMIT, tx, gtid, anchor, None))
        state.update((gtid, tx, anchor, file, serial))
        yield pd.DataFrame(out, columns=["row", "op", "boundary", "tx_id", "tx_gtid", "anchor", "event_serial"])

    packed = entries.select("server_id", arrival, "kind", "gtid", "file", F.col("pos").cast("string").alias("pos"), F.upper("query").alias("word"), F.to_json(F.struct(*names)).alias("row"))
    out = packed.groupBy("server_id").applyInPandasWithState(step, "row string, op string, boundary string, tx_id string, tx_gtid string, anchor string, event_serial string", "gtid string, tx string, anchor string, file string, serial long", "append", GroupStateTimeout.NoTimeout)
    back = out.withColumn("r", F.from_json("row", entries.schema)).select("r.*", "op", "boundary", "tx_id", "tx_gtid", F.col("anchor").cast("bigint").alias("anchor"), F.col("event_serial").cast("bigint").alias("event_serial"))
    return back


def transaction_order(log: DataFrame, tx: str = "txid", table: str = "tbl", arrival: str = "lsn", last: str = "is_last") -> DataFrame:
    """Adds total_order and collection_order; counters live until a row with ``last`` set ends the transaction."""
    schema = T.StructType([*log.schema.fields, T.StructField("total_order", T.LongType()), T.StructField("collection_order", T.LongType())])
    names = [f.name for f in schema.fields]

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(arrival)
        total, by_table = (state.get[0], dict(zip(state.get[1], state.get[2], strict=True))) if state.exists else (0, {})
        rows["total_order"] = range(total + 1, total + 1 + len(rows))
        rows["collection_order"] = rows.groupby(table).cumcount() + 1 + rows[table].map(lambda t: by_table.get(t, 0))
        if rows[last].any():
            if state.exists:
                state.remove()
        else:
            for t, n in rows[table].value_counts().items():
                by_table[t] = by_table.get(t, 0) + int(n)
            state.update((total + len(rows), list(by_table), list(by_table.values())))
        yield rows[names]

    return log.groupBy(tx).applyInPandasWithState(number, schema, "total long, tables array<string>, counts array<long>", "append", GroupStateTimeout.NoTimeout)


#: How a transaction ends in a log: its rows go on, or they go.
ENDS = {"commit": True, "stream_commit": True, "commit_prepared": True, "stream_abort": False, "rollback": False, "rollback_prepared": False}


def committed(entries: DataFrame, tx: str = "txid", order: str = "lsn") -> DataFrame:
    """Log entries of transactions whose commit has been seen, with their commits; entries outside a transaction pass.

    Rows of a transaction that is rolled back are never given out, those of one that is still open not yet: in a
    stream they wait in state, keyed by transaction, until an entry of ``ENDS`` releases or drops them (state lives
    as long as the transaction); a batch joins with the transactions that ended in it. Snapshot rows belong to none.
    """
    inside = F.col(tx).isNotNull() & ~F.col("kind").isin("read", "incremental", "snapshot_complete")
    free, bound = entries.filter(~F.coalesce(inside, F.lit(False))), entries.filter(inside)
    good, bad = [k for k, ok in ENDS.items() if ok], [k for k, ok in ENDS.items() if not ok]
    if not entries.isStreaming:
        ended = bound.filter(F.col("kind").isin(*ENDS)).groupBy(tx).agg(F.max(F.col("kind").isin(*bad)).alias("_bad")).filter(~F.col("_bad")).select(tx)
        return free.unionByName(bound.join(ended, tx, "left_semi").select(*entries.columns))

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for kind, row in pd.concat(list(batches)).sort_values(order)[["kind", "row"]].itertuples(index=False):
            if ENDS.get(kind, True):
                held.append(row)
            if kind in good:
                yield pd.DataFrame({"row": held})
            if kind in ENDS:
                held = []
        if held:
            state.update((held,))
        elif state.exists:
            state.remove()

    # rows travel as one JSON text: pandas would turn 64-bit integers next to nulls into doubles
    packed = bound.select(tx, order, "kind", F.to_json(F.struct(*entries.columns)).alias("row"))
    out = packed.groupBy(tx).applyInPandasWithState(hold, "row string", "rows array<string>", "append", GroupStateTimeout.NoTimeout)
    return free.unionByName(out.select(F.from_json("row", entries.schema).alias("r")).select("r.*"))


def window_survivors(rows: DataFrame) -> DataFrame:
    """Interleaves chunks with the log: what is left of each chunk when its window closes.

    ``rows`` (collection, kind, chunk, k, row, lsn): kind is ``chunk`` (a row read),
    ``event`` (the log touched a key) or ``close`` (the window's end). Rows of an open window wait in
    state, keyed by collection; an event evicts, a close emits them at its position.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(state.get[0], state.get[1], strict=True)) if state.exists else {}
        out = []
        for r in pd.concat(list(batches)).sort_values(["lsn", "kind"]).itertuples():
            if r.kind == "chunk":
                held[int(r.k)] = r.row
            elif r.kind == "event":
                held.pop(int(r.k), None)
            else:
                out += [(key[0], k, row, int(r.lsn)) for k, row in sorted(held.items())]
                held = {}
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["collection", "k", "row", "lsn"])

    return rows.groupBy("collection").applyInPandasWithState(step, "collection string, k bigint, row string, lsn bigint", "keys array<long>, rows array<string>", "append", GroupStateTimeout.NoTimeout)


def drop_repeats(records: DataFrame, event_time: str, within: str = "10 minutes", event_id: str = "event_id") -> DataFrame:
    """For consumers: records of one id within the watermark's reach count once."""
    return records.withWatermark(event_time, within).dropDuplicatesWithinWatermark([event_id])


def signal_files(spark, path: str, max_files: int = 16) -> DataFrame:
    """Control signals from a directory: one JSON object a line; blank and unreadable lines are dropped."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    parsed = lines.filter(F.trim("value") != "").select(F.from_json("value", "id string, type string, data string").alias("s"))
    return parsed.filter(F.col("s.id").isNotNull() & F.col("s.type").isNotNull()).select("s.id", "s.type", F.coalesce("s.data", F.lit("{}")).alias("data"))
