"""Source positions: sort keys, comparison, resume and retention decisions.

A position becomes a struct whose fields are in order of significance, so Spark's
lexicographic struct comparison is the position order. Rows of a snapshot sort before
streamed rows at the same coordinate. Families do not compare with each other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import U64

FAMILIES = ("postgresql", "mysql", "sqlserver", "oracle", "mongodb", "bridge")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sort_key(family: str, **fields: Column | str) -> Column:
    """The sort key of a position; ``fields`` are its columns.

    postgresql: lsn; mysql: file, pos; sqlserver: database, commit_lsn, change_lsn;
    oracle: scn, commit_scn; mongodb: seconds, increment; bridge: none. All: snapshot, serial.
    """
    c = {k: _col(v) for k, v in fields.items()}
    stream = (~F.coalesce(c.get("snapshot", F.lit(False)), F.lit(False))).cast("int").alias("is_stream")
    serial = F.coalesce(c.get("serial", F.lit(0)).cast("bigint"), F.lit(0)).alias("serial")
    if family == "postgresql":
        lead = [c["lsn"].cast(U64).alias("lsn")]
    elif family == "mysql":
        lead = [c["file"].cast("string").alias("file"), c["pos"].cast(U64).alias("pos")]
    elif family == "sqlserver":
        lead = [c["database"].alias("database"), c["commit_lsn"].alias("commit_lsn"), c["change_lsn"].alias("change_lsn")]
    elif family == "oracle":
        # commit order first; the entries of a transaction in the order of the log
        lead = [F.coalesce(c.get("commit_scn", F.lit(None)), c["scn"]).cast(U64).alias("commit_scn")]
    elif family == "mongodb":
        lead = [F.coalesce(c["seconds"], F.lit(0)).cast("bigint").alias("seconds"), F.coalesce(c["increment"], F.lit(0)).cast("bigint").alias("increment")]
    elif family == "bridge":
        lead = []
    else:
        raise ValueError(f"unknown family: {family}")
    return F.struct(*lead, stream, serial)


def behind(columns, values, inclusive: bool = False) -> Column:
    """Lexicographic comparison of columns with literal values, as a disjunction: it coerces types and reaches the scan."""
    out, same = F.lit(False), F.lit(True)
    for name, value in zip(columns, values, strict=True):
        out = out | (same & (F.col(name) > value))
        same = same & (F.col(name) == value)
    bound = F.col(columns[0]) >= values[0]
    return bound & (out | same if inclusive else out)


def upto(columns, values) -> Column:
    """The columns are at or before the literal values."""
    out, same = F.lit(False), F.lit(True)
    for name, value in zip(columns, values, strict=True):
        out = out | (same & (F.col(name) < value))
        same = same & (F.col(name) == value)
    return (F.col(columns[0]) <= values[0]) & (out | same)


def is_after(a: Column, b: Column) -> Column:
    return a > b


def is_at_or_before(a: Column, b: Column) -> Column:
    return a <= b


def comparable(family_a: Column, family_b: Column, partition_a: Column, partition_b: Column) -> Column:
    """Positions compare within a family, and for the bridge within one upstream connector."""
    return (family_a == family_b) & ((family_a != "bridge") | (partition_a == partition_b))


def resume_decision(strategy: Column | str, checkpoint: Column | str, slot: Column | str, in_transaction: Column | None = None) -> Column:
    """use_checkpoint, use_slot, advance_slot or error, by strategy and the two positions.

    A slot is not advanced to a checkpoint inside a transaction.
    """
    s, ck, sl = _col(strategy), _col(checkpoint), _col(slot)
    advance = F.lit("advance_slot") if in_transaction is None else F.when(in_transaction, "error").otherwise("advance_slot")
    return (
        F.when((s == "no_validation") | (ck == sl), "use_checkpoint")
        .when(s == "trust_offset", F.when(ck > sl, advance).otherwise("error"))
        .when(s == "trust_slot", F.when(ck > sl, "use_checkpoint").otherwise("use_slot"))
        .when(s == "trust_greater_lsn", F.when(ck > sl, advance).otherwise("use_slot"))
        .otherwise("error")
    )


def retention_decision(available: Column | str, resume: Column | str, mode: Column | str) -> Column:
    """ok, resnapshot or error: whether the log still holds the resume position."""
    lost = _col(available) > _col(resume)
    return F.when(~F.coalesce(lost, F.lit(False)), "ok").when(_col(mode) == "when_needed", "resnapshot").otherwise("error")


def lsn_hex(c: Column | str, width: int = 20) -> Column:
    """A log sequence number as ``0x`` and lower-case hex; 10 bytes by default."""
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(_col(c).cast("bigint")), width, "0")))


def lsn_bytes(c: Column | str) -> Column:
    """``0x``-hex back to bytes; null unless it is 10 bytes."""
    text = _col(c)
    return F.when(text.rlike("^0[xX][0-9a-fA-F]{20}$"), F.unhex(F.substring(text, 3, 20)))


#: First and last log sequence number.
LSN_ZERO = "0x" + "00" * 10
LSN_MAX = "0x" + "ff" * 10
