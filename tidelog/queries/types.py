"""Type conversions by source family, and masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import positions, types_mssql, types_mysql, types_pg
from ..functions.masking import Rule, hash_column, is_character, mask_image, masked, rule_for
from ..plans.changelog import read
from .registry import literal, query, table

_PG = [("t", "12", "1.5", "\\x00ff", "x"), ("f", "twelve", "NaN", "\\xzz", None), ("maybe", "-7", "abc", None, "")]
_PG_S = "b string, i string, f string, y string, s string"


@query(f"""WITH t AS ({literal(_PG_S, _PG)}) SELECT CASE b WHEN 't' THEN true WHEN 'f' THEN false END AS b, TRY_CAST(i AS INTEGER) AS i, TRY_CAST(i AS INTEGER) IS NULL AS i_failed,
CASE WHEN f = 'NaN' THEN NULL ELSE TRY_CAST(f AS DOUBLE) END AS f, CASE WHEN regexp_full_match(y, '\\\\x([0-9a-fA-F]{{2}})*') THEN lower(y[3:]) END AS y_hex, s FROM t""")
def q_pg_types(spark, d):
    rows = table(spark, _PG_S, _PG)
    i, failed = types_pg.typed(F.col("i"), "int")
    f, _ = types_pg.typed(F.col("f"), "double")
    return rows.select(types_pg.boolean(F.col("b")).alias("b"), i.alias("i"), failed.alias("i_failed"), F.when(~F.isnan(f), f).alias("f"), F.lower(F.hex(types_pg.bytea(F.col("y")))).alias("y_hex"), "s")


_txt = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
_say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _styles(style: Column, *texts: Column) -> Column:
    """The text of a row's style."""
    return F.element_at(F.array(*texts), (style % len(texts) + 1).cast("int"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey * 7919 % 100000000 AS n, o_orderkey % 7 AS style FROM orders), c AS (SELECT *, (n + 5) // 10 AS cents FROM o)
SELECT o_orderkey, CASE WHEN style = 5 THEN NULL ELSE CASE WHEN style IN (1, 2, 6) AND cents > 0 THEN '-' ELSE '' END || (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') END AS amount FROM c""")
def q_money(spark, d):
    """Amounts of three decimals in seven spellings, one of them no amount."""
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 100_000_000).alias("n"))
    plain = F.concat(F.format_number(F.expr("n div 1000"), 0), F.lit("."), F.lpad(_txt(F.col("n") % 1000), 3, "0"))
    text = _styles(F.col("o_orderkey"), _say("$", plain), _say("-$", plain), _say("($", plain, ")"), _say("€", plain), plain, _say("n/a ", plain), _say(" - ", plain))
    return o.select("o_orderkey", types_pg.money(text).cast("string").alias("amount"))


_PARTS = """WITH e AS (SELECT event_id AS e, event_id % 5 AS style, event_id % 4 AS y, event_id % 12 AS mo, event_id % 31 AS d, event_id % 24 AS h, event_id % 60 AS mi, event_id * 7 % 60 AS s, event_id * 13 % 1000000 AS us FROM events),
p AS (SELECT *, CASE style WHEN 1 THEN -1 WHEN 3 THEN -1 ELSE 1 END AS sign, style IN (0, 1, 2) AS dated, CASE WHEN style = 1 THEN 0 ELSE s END AS sec, CASE WHEN style = 0 THEN us ELSE 0 END AS frac FROM e),
q AS (SELECT *, CASE WHEN style < 4 THEN CASE WHEN dated THEN sign * (y * 12 + mo) ELSE 0 END END AS months, CASE WHEN style < 4 THEN CASE WHEN dated THEN sign * d ELSE 0 END END AS days,
  CASE WHEN style < 4 THEN sign * ((h * 3600 + mi * 60 + sec) * 1000000 + frac) END AS micros FROM p)"""


def _intervals(spark, d):
    """Intervals spelled out, spelled out and negated, in the ISO form, as a negative clock, and something else."""
    e = F.col("event_id")
    y, mo, day, h, mi, s, us = e % 4, e % 12, e % 31, e % 24, e % 60, e * 7 % 60, e * 13 % 1_000_000
    two = lambda c: F.lpad(_txt(c), 2, "0")
    clock = _say(two(h), ":", two(mi), ":", two(s))
    text = _styles(e, _say(y, " years ", mo, " mons ", day, " days ", clock, ".", F.lpad(_txt(us), 6, "0")), _say("@ ", y, " years ", mo, " mons ", day, " days ", h, " hours ", mi, " mins ago"), _say("P", y, "Y", mo, "M", day, "DT", h, "H", mi, "M", s, "S"), _say("-", clock), _say("in ", day, " days"))
    return read(spark, d, "events").select("event_id", types_pg.interval_parts(text).alias("p"))


@query(f"{_PARTS} SELECT e AS event_id, months, days, micros FROM q")
def q_interval(spark, d):
    return _intervals(spark, d).select("event_id", "p.months", "p.days", "p.micros")


@query(f"""{_PARTS} SELECT e AS event_id, months * 2629800000000 + days * 86400000000 + micros AS total_micros,
CASE WHEN style < 4 THEN 'P' || CASE WHEN dated THEN sign * y ELSE 0 END || 'Y' || CASE WHEN dated THEN sign * mo ELSE 0 END || 'M' || days || 'DT' || sign * h || 'H' || sign * mi || 'M' || CASE WHEN sign < 0 AND sec > 0 THEN '-' ELSE '' END || sec || CASE WHEN frac > 0 THEN rtrim('.' || lpad(frac::VARCHAR, 6, '0'), '0') ELSE '' END || 'S' END AS iso FROM q""")
def q_interval_micros(spark, d):
    return _intervals(spark, d).select("event_id", types_pg.interval_micros(F.col("p")).alias("total_micros"), types_pg.interval_iso(F.col("p")).alias("iso"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"n":"' || event_id || '","type":"' || event_type || '","z":null}' WHEN 1 THEN '{"a b":"=>' || event_id || '","q":"x, \\"' || event_type || '\\""}' WHEN 2 THEN '{}' END AS as_json FROM events""")
def q_hstore(spark, d):
    """Quoted and bare, with escapes, empty, and malformed."""
    n, t = F.col("event_id"), F.col("event_type")
    text = _styles(n, _say('"type"=>"', t, '", z=>NULL, "n"=>', n), _say('q=>"x, \\"', t, '\\"", "a b"=>"=>', n, '"'), F.lit(" "), _say(t, "=", n))
    m = read(spark, d, "events").select("event_id", types_pg.hstore(text).alias("m"))
    return m.select("event_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("m"))), {"ignoreNullFields": "false"}).alias("as_json"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id + event_id % 7 + 0.5 - 3 END::DOUBLE AS dense_sum, CASE event_id % 3 WHEN 1 THEN 5 END AS dimensions, CASE event_id % 3 WHEN 1 THEN 2 END AS nonzero, CASE event_id % 3 WHEN 1 THEN event_id % 9 END::DOUBLE AS third FROM events""")
def q_vector(spark, d):
    n = F.col("event_id")
    text = _styles(n, _say("[", n, ",", n % 7, ".5,-3]"), _say("{1:0.5, 3:", n % 9, "}/5"), _say("[", n))
    rows = read(spark, d, "events").select("event_id", types_pg.dense_vector(text).alias("dense"), types_pg.sparse_vector(text).alias("sparse"))
    return rows.select("event_id", F.aggregate("dense", F.lit(0.0), lambda a, x: a + x).alias("dense_sum"), "sparse.dimensions", F.when(F.col("sparse").isNotNull(), F.size("sparse.vector")).alias("nonzero"), F.try_element_at("sparse.vector", F.lit(3)).alias("third"))


@query("SELECT vec_id, len(embedding)::INTEGER AS dimensions, embedding[1]::DOUBLE AS first, label FROM embeddings")
def q_vector_column(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dimensions"), F.get("embedding", 0).cast("double").alias("first"), "label")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '["' || event_id || '","2",null]' WHEN 1 THEN '["a ' || event_type || '","c\\"d","' || event_id || '"]' WHEN 2 THEN '["x","' || event_id || '"]' WHEN 3 THEN '["[\\"' || event_id || '\\", \\"2\\"]","[\\"3\\", null]"]' END AS as_json FROM events""")
def q_pg_array(spark, d):
    """Plain, quoted, with bounds, nested, and malformed arrays."""
    n = F.col("event_id")
    text = _styles(n, _say("{", n, ",2,NULL}"), _say('{"a ', F.col("event_type"), '","c\\"d",', n, "}"), _say("[0:1]={x,", n, "}"), _say("{{", n, ",2},{3,NULL}}"), _say("{", n, ",}"))
    rows = read(spark, d, "events").select("event_id", types_pg.array(text).alias("a"))
    return rows.select("event_id", F.to_json("a", {"ignoreNullFields": "false"}).alias("as_json"))


_MY = [("1", "18446744073709551615", "-5", "12.30"), ("0", "0", "x", "7"), (None, None, None, None)]


@query(f"""WITH t AS ({literal('flag string, big string, small string, dec string', _MY)}) SELECT TRY_CAST(flag AS BIGINT) <> 0 AS flag, big AS big, TRY_CAST(small AS BIGINT) AS small, dec FROM t""")
def q_mysql_types(spark, d):
    rows = table(spark, "flag string, big string, small string, dec string", _MY)
    v = lambda c, t: types_mysql.value(F.col(c), t)
    return rows.select(v("flag", "tinyint(1)").alias("flag"), v("big", "bigint unsigned").cast("string").alias("big"), v("small", "int(11)").alias("small"), v("dec", "decimal(10,2)").alias("dec"))


@query("""SELECT event_id, strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END AS text FROM events""")
def q_mysql_timestamp(spark, d):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    epoch = F.concat(F.expr("us div 1000000").cast("string"), F.lit("."), F.lpad((F.col("us") % 1000000).cast("string"), 6, "0"))
    return read(spark, d, "events").withColumn("us", us).select("event_id", types_mysql.timestamp_text(epoch).alias("text"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 3 = 0 THEN (event_id * 37 % 6040798 - 3020399) * 1000000 ELSE event_id * 37000003 % 6040798000001 - 3020399000000 END AS us FROM events), a AS (SELECT *, abs(us) AS x, abs(us) // 3600000000 AS h FROM e)
SELECT event_id, us AS micros, CASE WHEN us < 0 THEN '-' ELSE '' END || CASE WHEN h < 10 THEN '0' ELSE '' END || h || ':' || lpad((x // 60000000 % 60)::VARCHAR, 2, '0') || ':' || lpad((x // 1000000 % 60)::VARCHAR, 2, '0') || CASE WHEN x % 1000000 > 0 THEN '.' || lpad((x % 1000000)::VARCHAR, 6, '0') ELSE '' END AS text FROM a""")
def q_mysql_time(spark, d):
    """Times from -838:59:59 to 838:59:59, with and without a fraction."""
    n = F.col("event_id")
    us = F.when(n % 50 == 0, None).when(n % 3 == 0, (n * 37 % 6040798 - 3020399) * 1_000_000).otherwise(n * 37000003 % 6040798000001 - 3020399000000)
    return read(spark, d, "events").select("event_id", us.alias("micros")).withColumn("text", types_mysql.time_text(F.col("micros")))


@query("""SELECT event_id, coalesce((['low', 'mid', 'high'])[(event_id % 5)::INTEGER], '') AS label, array_to_string(list_filter([CASE WHEN event_id % 8 & 1 > 0 THEN 'a' END, CASE WHEN event_id % 8 & 2 > 0 THEN 'b' END, CASE WHEN event_id % 8 & 4 > 0 THEN 'c' END], lambda x: x IS NOT NULL), ',') AS labels FROM events""")
def q_enum_set(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", types_mysql.enum_label(F.col("event_id") % 5, ["low", "mid", "high"]).alias("label"), types_mysql.set_labels(F.col("event_id") % 8, ["a", "b", "c"]).alias("labels"))


_MS = [("1", "0x00ff", "A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11", "2024-01-02 03:04:05.6", "12.50"), ("false", "AB", None, "2024-01-02", "1"), (None, None, None, None, None)]


@query(f"""WITH t AS ({literal('flag string, bin string, guid string, at_ string, amount string', _MS)}) SELECT CASE WHEN flag IN ('1', 'true') THEN true WHEN flag IN ('0', 'false') THEN false END AS flag, lower(regexp_replace(bin, '^0[xX]', '')) AS bin_hex, lower(guid) AS guid,
regexp_replace(at_, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}) ', '\\1T') AS at_, amount FROM t""")
def q_mssql_types(spark, d):
    rows = table(spark, "flag string, bin string, guid string, at_ string, amount string", _MS)
    v = lambda c, t: types_mssql.value(F.col(c), t)
    return rows.select(v("flag", "bit").alias("flag"), F.lower(F.hex(v("bin", "varbinary(4)"))).alias("bin_hex"), v("guid", "uniqueidentifier").alias("guid"), v("at_", "datetime2(4)").alias("at_"), v("amount", "decimal(20,4)").alias("amount"))


@query("SELECT event_id, '0x' || lower(lpad(hex(event_id * 7919), 20, '0')) AS lsn, lower(lpad(hex(event_id * 7919), 20, '0')) AS bytes_hex FROM events")
def q_lsn_format(spark, d):
    rows = read(spark, d, "events").select("event_id", positions.lsn_hex(F.col("event_id") * 7919).alias("lsn"))
    return rows.select("event_id", "lsn", F.lower(F.hex(positions.lsn_bytes("lsn"))).alias("bytes_hex"))


# masking


@query("SELECT doc_id, left(text, 12) AS text, lang FROM documents")
def q_mask_truncate(spark, d):
    rule = Rule("app.docs.text", "truncate", length=12)
    return read(spark, d, "documents").select("doc_id", masked(F.col("text"), rule, "varchar(40000)").alias("text"), masked(F.col("lang"), rule, "varchar(8)").alias("lang"))


@query("SELECT c_custkey, '*****' AS c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS plain, '*****' AS masked_null FROM customer")
def q_mask_fixed(spark, d):
    rule = Rule(".*", "mask", length=5)
    segment = F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment"))
    return read(spark, d, "customer").select("c_custkey", masked(F.col("c_name"), rule, "varchar(25)").alias("c_name"), segment.alias("plain"), masked(segment, rule, "varchar(10)").alias("masked_null"))


@query("SELECT c_custkey, sha256('salt123' || c_name) AS by_sha256, left(sha256('salt123' || c_name), 20) AS by_sha256_cut, md5('salt123' || c_name) AS by_md5, sha1('salt123' || c_name) AS by_sha1 FROM customer")
def q_mask_hash_v2(spark, d):
    c = F.col("c_name")
    return read(spark, d, "customer").select("c_custkey", hash_column(c, "SHA-256", "salt123", 2, None).alias("by_sha256"), hash_column(c, "SHA-256", "salt123", 2, 20).alias("by_sha256_cut"), hash_column(c, "MD5", "salt123", 2, None).alias("by_md5"), hash_column(c, "SHA-1", "salt123", 2, None).alias("by_sha1"))


@query("SELECT c_custkey, left(sha256('CzQMA0cB5K'::BLOB || '\\xAC\\xED\\x00\\x05\\x74\\x00\\x12'::BLOB || encode(c_name)), 20) AS hashed FROM customer")
def q_mask_hash_v1(spark, d):
    return read(spark, d, "customer").select("c_custkey", hash_column(F.col("c_name"), "SHA-256", "CzQMA0cB5K", 1, 20).alias("hashed"))


#: Digests of "s" and a segment's name, made with other implementations, for what DuckDB has no function for.
_DIGESTS = [
    ("AUTOMOBILE", "baae8495957b7f5c13c6ed16bde33ead", "69bbbb9e20d43ff1fe160a8ebf2a455d6eedf4f3fb6e22dda42004ab21314abe", "7be7ea4010b98c80d610f1cc1e31c05503ffeb9b70b746519a8976f89e12a1f1"),
    ("BUILDING", "a9c05a42d99733226edc6269f04fc12d", "b56a370a4afd0f99cc0a0a6d05e29100f4f7fbd5544f47237b549425a3af213d", "796c211c0da7008e3812adb1245cd7420564caad6f8c345edf1fea0c1fbd438e"),
    ("FURNITURE", "76bb92390db383c51d6ff3ab6ee28203", "6637b5c4e5a4da53ce00486b2ed0939a4f934674b70a70172da09158aab6b5c0", "02d6d78474b4aa837518de121543e3e1de5d6e1875dc38c0e7d328f658c46015"),
    ("HOUSEHOLD", "12de6e90d80deef18d4950c58a43db4e", "2ecc63e0049b4721d11b4e3813e0eeed7de4751007371213146ebd1b1bde5b2e", "9971a8ebee7acad74abc97fe830b936982f82b46e1d7ccabfc2dea85816ea641"),
    ("MACHINERY", "0924aa921c1fa1f4f3929d8c6561d3ad", "20fb3b68e060d076bf9914af2059a84f9f213b31a2bc82b86f2190fbd4c470bf", "38641028cc23fda0c236cea647b89b99d43ac8bdb5be6b5cb13eeb87620df546"),
]


@query(f"WITH h AS ({literal('segment string, md2 string, sha3_256 string, sha_512_256 string', _DIGESTS)}) SELECT c_custkey, md2, sha3_256, sha_512_256 FROM customer JOIN h ON segment = c_mktsegment")
def q_mask_hash_library(spark, d):
    """Algorithms that neither Spark nor DuckDB has."""
    c = F.col("c_mktsegment")
    return read(spark, d, "customer").select("c_custkey", *[hash_column(c, a, "s", 2, None).alias(a.replace("-", "_").replace("/", "_").lower()) for a in ("MD2", "SHA3-256", "SHA-512/256")])


@query("""SELECT c_custkey, left(c_name, 8) AS c_name, '***' AS c_mktsegment, c_nationkey FROM customer""")
def q_mask_rules(spark, d):
    """Rules resolved against a schema: the first by kind wins, selectors ignore case, other types are left alone."""
    rules = [Rule(r"app\.customer\.C_.*", "mask", length=3), Rule(r"app\.customer\.c_name", "truncate", length=8)]
    fields = {"c_name": "varchar(25)", "c_mktsegment": "varchar(10)", "c_nationkey": "int"}
    rows = read(spark, d, "customer").select("c_custkey", F.struct(*fields).alias("after"))
    return rows.select("c_custkey", mask_image("after", fields, rules, "mysql", "app", None, "customer").alias("a")).select("c_custkey", "a.*")


_SELECT = [("public", "users", "email", "varchar(20)"), ("public", "users", "Age", "integer"), ("Public", "Users", "EMAIL", "text"), ("audit", "users", "email", "text[]")]


@query(f"WITH t AS ({literal('s string, t string, c string, k string', _SELECT)}) SELECT *, regexp_full_match(s || '.' || t || '.' || c, 'public\\.users\\.(email|age)', 'i') AS chosen, k IN ('varchar(20)', 'text') AS character_type FROM t")
def q_column_selectors(spark, d):
    rules = [Rule(r"public\.users\.(email|age)", "mask", length=1)]
    rows = [(*r, rule_for(rules, [".".join(r[:3])]) is not None, is_character(r[3])) for r in _SELECT]
    return table(spark, "s string, t string, c string, k string, chosen boolean, character_type boolean", rows)
