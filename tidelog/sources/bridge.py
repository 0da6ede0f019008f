"""Bridge source: change envelopes made elsewhere, as JSON text.

A landing directory (or a Kafka topic, where that connector is on the classpath) is read
as a stream of documents; at most four wrappers are taken off, unrolled so that the plan
has no loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import bridge_id
from ..functions.types_doc import bridge_micros
from ..model import COMMIT, DATA, HEARTBEAT, SNAPSHOT_COMPLETE


#: The parts of an envelope that are read; objects stay JSON text.
PAYLOAD = (
    "before string, after string, op string, status string, ddl string, transaction struct<id:string>, source struct<connector:string,db:string,`schema`:string,`table`:string,collection:string,"
    "snapshot:string,ts_ns:string,ts_us:string,ts_ms:string,txId:string,server_transaction_id:string,vgtid:string>"
)


def unwrap(doc: Column, layers: int = 4) -> Column:
    """Takes off ``data`` (next to ``specversion``), ``payload`` (next to ``schema``), and string layers.

    Each layer is bound by a lambda, or the expression would double with every layer. A layer
    that finds no wrapper ends the unwrapping, so a bare document is parsed for one only once.
    """

    def layer(state: Column) -> Column:
        d = state["doc"]
        quoted = d.startswith('"')
        wrap = F.from_json(F.when(quoted, F.concat(F.lit('{"text":'), d, F.lit("}"))).otherwise(d), "text string, specversion string, data string, `schema` string, payload string")
        inner = lambda w: F.when(quoted & w["text"].isNotNull(), w["text"]).when(w["specversion"].isNotNull() & w["data"].isNotNull(), w["data"]).when(w["schema"].isNotNull() & w["payload"].isNotNull(), w["payload"])
        found = F.transform(F.array(wrap), lambda w: inner(w))[0]
        return F.when(state["wrapped"], F.transform(F.array(found), lambda x: F.struct(F.coalesce(x, d).alias("doc"), x.isNotNull().alias("wrapped")))[0]).otherwise(state)

    state = F.struct(doc.alias("doc"), F.lit(True).alias("wrapped"))
    for _ in range(layers):
        state = F.transform(F.array(state), layer)[0]
    return state["doc"]


def document_id(doc: Column, header: Column | None = None) -> Column:
    """The record id: the sender's, else a hash of the document."""
    own = F.concat(F.lit("sha256:"), F.sha2(doc, 256))
    return own if header is None else F.coalesce(header, own)


def kafka_id(topic: Column, partition: Column, offset: Column) -> Column:
    return F.concat_ws(":", F.lit("kafka"), topic, partition.cast("string"), offset.cast("string"))


def decode(docs: DataFrame, doc: str = "doc", record_id: Column | None = None, connector: str | None = None) -> DataFrame:
    """Envelope documents to change rows; images stay JSON text.

    A document of another connector is marked in ``problem``. The boundary is a
    transaction's END, then a snapshot's last record, then data, then a heartbeat.
    """
    rid = document_id(F.col(doc)) if record_id is None else record_id
    out = docs.withColumn("_p", F.from_json(unwrap(F.col(doc)), PAYLOAD)).withColumn("record_id", rid)
    p, src, number = F.col("_p"), F.col("_p.source"), lambda c: c.try_cast("bigint")
    is_data, is_ddl, snapshot = p["op"].isNotNull(), p["ddl"].isNotNull(), src["snapshot"]
    out = out.withColumns({
        "connector": src["connector"],
        "database": src["db"],
        "schema": src["schema"],
        "table": F.coalesce(src["table"], src["collection"], F.when(is_ddl, "_ddl")),
        "op": F.when(is_data, p["op"]).when(is_ddl, "m"),
        "is_snapshot": F.coalesce(snapshot.isin("true", "first", "first_in_data_collection", "last_in_data_collection", "last", "incremental"), F.lit(False)),
        "boundary": F.when(p["status"] == "END", COMMIT).when(is_data & (snapshot == "last"), SNAPSHOT_COMPLETE).when(is_data | is_ddl, DATA).otherwise(HEARTBEAT),
        "before": p["before"],
        "after": F.coalesce(p["after"], p["ddl"]),
        "tx_id": F.coalesce(p["transaction"]["id"], src["txId"], src["server_transaction_id"], src["vgtid"]),
        "source_us": bridge_micros(number(src["ts_ns"]), number(src["ts_us"]), number(src["ts_ms"])),
    }).drop("_p")
    out = out.withColumn("event_id", bridge_id(F.coalesce("connector", F.lit("")), F.col("record_id")))
    wrong = F.lit(None).cast("string") if connector is None else F.when(F.col("connector").isNotNull() & (F.col("connector") != connector), F.concat(F.lit("document of connector "), F.col("connector")))
    return out.withColumn("problem", wrong)


def read_stream(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """Documents from a landing directory, one a line; ``max_files`` bounds a micro-batch."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path).select(F.col("value").alias("doc"))


def read_kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int = 2_048) -> DataFrame:
    """Documents from a topic; needs Spark's Kafka connector. Empty payloads are skipped."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", max_offsets).load()
    return rows.filter(F.col("value").isNotNull()).select(F.col("value").cast("string").alias("doc"), kafka_id(F.col("topic"), F.col("partition"), F.col("offset")).alias("record_id"))
