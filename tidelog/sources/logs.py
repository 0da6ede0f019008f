"""Log sources: raw log rows to change rows, by source family.

Each function takes a DataFrame of raw entries (batch or stream) and returns changes;
nothing here looks across rows unless the log itself does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.positions import behind
from ..functions.types_oracle import redo_json
from ..model import COMMIT, DATA

# PostgreSQL


def decode_wal(entries: DataFrame, selected: Column) -> DataFrame:
    """Logical replication entries to records: ``op`` and ``boundary``; entries without either are dropped.

    kind: begin, insert, update, delete, truncate, message, commit, stream_commit,
    stream_abort, rollback_prepared, relation, origin, type. Data of unselected tables is
    dropped, commits are kept, so positions go on. What an aborted transaction wrote is dropped.
    """
    kind = F.col("kind")
    aborted = entries.filter(kind.isin("stream_abort", "rollback_prepared")).select("txid").distinct()
    op = F.when(kind == "insert", "c").when(kind == "update", "u").when(kind == "delete", "d").when(kind == "truncate", "t")
    boundary = F.when(kind.isin("commit", "stream_commit"), COMMIT).when(op.isNotNull(), DATA)
    out = entries.withColumns({"op": op, "boundary": boundary}).filter(F.col("boundary").isNotNull())
    out = out.filter((F.col("boundary") == COMMIT) | selected)
    return out.join(aborted, "txid", "left_anti")


def truncates(entries: DataFrame, tables: str = "tables", first_only: bool = False) -> DataFrame:
    """One event for each table that a truncate names; ``first_only`` keeps the first, as some consumers expect."""
    named = F.slice(tables, 1, 1) if first_only else F.col(tables)
    return entries.filter(F.col("kind") == "truncate").withColumn("table", F.explode(named)).withColumn("op", F.lit("t"))


def logical_messages(entries: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Message records; those outside a transaction are their own commit. A filtered one keeps its position but no event."""
    prefix = F.col("prefix")
    chosen = F.lit(True) if not include else F.lit(False)
    for p in include:
        chosen = chosen | prefix.rlike(f"^(?:{p})$")
    for p in exclude:
        chosen = chosen & ~prefix.rlike(f"^(?:{p})$")
    rows = entries.filter(F.col("kind") == "message").withColumn("chosen", chosen)
    rows = rows.filter(F.col("chosen") | ~F.col("transactional"))
    return rows.withColumns({"op": F.when(F.col("chosen"), "m"), "boundary": F.when(F.col("transactional"), DATA).otherwise(COMMIT)})


# MySQL


def transaction_id(gtid: Column, file: Column, anchor: Column) -> Column:
    """The GTID of a transaction, or where it starts in the log."""
    return F.coalesce(gtid, F.concat_ws(":", file, anchor.cast("string")))


def decode_binlog(entries: DataFrame, arrival: str = "arrival", partition: Sequence[str] = ("server_id",)) -> DataFrame:
    """Binlog entries to records: every row carries the transaction and the table-map anchor it belongs to.

    kind: gtid, query, table_map, write, update, delete, xid. ``query`` holds BEGIN,
    COMMIT, ROLLBACK or DDL. Rows share the position of their table map and differ by serial.
    Work is spread by log file, not by server; entries name their ``file``.
    """
    kind, at = F.col("kind"), F.col(arrival)
    starts = (kind == "gtid") | ((kind == "query") & (F.upper("query") == "BEGIN"))
    tx, anchor = F.when(starts, F.struct(F.col("gtid"), F.col("file"), F.col("pos"))), F.when(kind == "table_map", F.col("pos"))
    # what is open where a file ends goes on into the next: one small row a file
    files = entries.groupBy(*partition, "file").agg(F.min(at).alias("_since"), F.max_by(tx, F.when(starts, at)).alias("_tx"), F.max_by(anchor, F.when(kind == "table_map", at)).alias("_anchor"))
    before = W.partitionBy(*partition).orderBy("_since").rowsBetween(W.unboundedPreceding, -1)
    carried = files.select(*partition, "file", F.last("_tx", ignorenulls=True).over(before).alias("_tx_before"), F.last("_anchor", ignorenulls=True).over(before).alias("_anchor_before"))
    so_far = W.partitionBy(*partition, "file").orderBy(arrival).rowsBetween(W.unboundedPreceding, 0)
    out = entries.withColumns({"_tx": F.last(tx, ignorenulls=True).over(so_far), "anchor": F.last(anchor, ignorenulls=True).over(so_far)}).join(carried, [*partition, "file"])
    out = out.withColumns({"_tx": F.coalesce("_tx", "_tx_before"), "anchor": F.coalesce("anchor", "_anchor_before")}).drop("_tx_before", "_anchor_before")
    op = F.when(kind == "write", "c").when(kind == "update", "u").when(kind == "delete", "d")
    end = (kind == "xid") | ((kind == "query") & F.upper("query").isin("COMMIT", "ROLLBACK"))
    out = out.withColumns({"op": op, "boundary": F.when(op.isNotNull(), DATA).when(end, COMMIT), "tx_id": transaction_id(F.col("_tx.gtid"), F.col("_tx.file"), F.col("_tx.pos")), "tx_gtid": F.col("_tx.gtid")}).filter(F.col("boundary").isNotNull())
    same_map = W.partitionBy(*partition, "file", "anchor").orderBy(arrival)
    return out.withColumn("event_serial", F.when(F.col("op").isNotNull(), F.sum(F.col("op").isNotNull().cast("bigint")).over(same_map))).drop("_tx")


def filter_origin(records: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), tx: str = "tx_id") -> DataFrame:
    """Drops data of transactions from other servers (by the GTID's source), keeps their commits so progress goes on.

    Patterns match the whole source id, whatever its case.
    """
    if include and exclude:
        raise ValueError("give sources to include or to exclude, not both")
    source = F.split_part(F.col(tx), F.lit(":"), F.lit(1))
    hit = F.lit(False)
    for p in include or exclude:
        hit = hit | source.rlike(f"(?i)^(?:{p})$")
    chosen = hit if include else ~hit
    return records.filter((F.col("boundary") == COMMIT) | chosen)


def filter_gtid_set(gtids: Column, include: Sequence[str]) -> Column:
    """The members of a GTID set whose source matches."""
    def chosen(member: Column) -> Column:
        source, hit = F.trim(F.split_part(member, F.lit(":"), F.lit(1))), F.lit(False)
        for p in include:
            hit = hit | source.rlike(f"(?i)^(?:{p})$")
        return hit

    return F.array_join(F.transform(F.filter(F.split(gtids, ","), chosen), lambda x: F.trim(x)), ",")


# SQL Server


def poll_changes(tables: dict[str, DataFrame], after: tuple, maximum: str, limit: int, columns: Sequence[str]) -> DataFrame:
    """The next ``limit`` + 1 changes of all change tables behind a three-part cursor and not beyond ``maximum``, in order.

    Rows are packed as JSON, so tables with different columns make one ordered set.
    """
    parts = None
    for name, rows in sorted(tables.items()):
        packed = rows.select("commit_lsn", "change_lsn", "operation", F.lit(name).alias("capture"), F.to_json(F.struct(*[c for c in columns if c in rows.columns]), {"ignoreNullFields": "false"}).alias("row"))
        parts = packed if parts is None else parts.unionByName(packed)
    return parts.filter(behind(["commit_lsn", "change_lsn", "operation"], after) & (F.col("commit_lsn") <= maximum)).orderBy("commit_lsn", "change_lsn", "operation", "capture").limit(limit + 1)


# Oracle


def decode_logminer(entries: DataFrame, after: tuple, limit: int | None = None) -> DataFrame:
    """LogMiner rows behind (scn, rs_id, ssn): 1 insert, 2 delete, 3 update, 5 DDL, 7 commit; others are dropped.

    Redo text gives the after-image, undo text the before-image.
    """
    code = F.col("operation_code")
    rows = entries.filter(behind(["scn", "rs_id", "ssn"], after) & code.isin(1, 2, 3, 5, 7))
    rows = rows.orderBy("scn", "rs_id", "ssn").limit(limit) if limit else rows
    return rows.withColumns({
        "op": F.when(code == 1, "c").when(code == 2, "d").when(code == 3, "u").when(code == 5, "m"),
        "boundary": F.when(code == 7, COMMIT).otherwise(DATA),
        "after": F.when(code.isin(1, 3), redo_json("sql_redo")),
        "before": F.when(code.isin(2, 3), redo_json("sql_undo")),
    })


# MongoDB


def decode_document_change(kind: Column, full: Column, updated: Column, before: Column, key: Column) -> tuple[Column, Column, Column]:
    """(op, before, after) of a change-stream event; documents are JSON objects as text.

    An update without the full document gives what was set together with the key.
    """
    op = F.when(kind == "insert", "c").when(kind.isin("replace", "update"), "u").when(kind == "delete", "d").otherwise("m")
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    entries = F.map_entries(F.map_concat(F.map_filter(as_map(key), lambda k, _: ~F.map_contains_key(as_map(updated), k)), as_map(updated)))
    partial = F.to_json(F.map_from_entries(F.array_sort(entries)), {"ignoreNullFields": "false"})
    after = F.when(kind.isin("insert", "replace"), full).when(kind == "update", F.coalesce(full, partial))
    return op, F.when(kind == "delete", F.coalesce(before, key)).when(kind.isin("replace", "update"), before), after
