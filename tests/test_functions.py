"""Scalar helpers: known vectors and round trips."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.encode import avro, kinds, protobuf
from tidelog.functions import json_diff, masking, types_doc, types_oracle, types_pg
from tidelog.operators.schema_history import Field, SchemaHistory, Table, evolve_from_relation


def test_hash_vectors():
    assert masking.digest("SHA-256", b"CzQMA0cB5K" + masking.java_string("test"))[:20] == "8e68c68edbbac316dfe2"
    assert masking.digest("SHA-256", b"salt12312345678901234567890") == "b65875d34a3dedf070f3a012970bf3b5da424560d7be3d2c23b986b525d2d7f3"
    assert masking.md2(b"") == "8350e5a3e24c153df2275c9f80692773"
    assert masking.md2(b"abcdefghijklmnopqrstuvwxyz") == "4e8ddff3650292ab5a4108c3aa47940b"
    assert masking.digest("SHA3-256", b"x") == hashlib.sha3_256(b"x").hexdigest()


def test_java_string_special_characters():
    assert masking.java_string("\0é€")[4:] == b"\x74\x00\x07\xc0\x80\xc3\xa9\xe2\x82\xac"
    assert masking.java_string("😀")[7:] == b"\xed\xa0\xbd\xed\xb8\x80"
    assert masking.java_string("a" * 70000)[4:5] == b"\x7c"


@pytest.mark.parametrize(("declared", "expected"), [("varchar(20)", True), ("pg_catalog.text", True), ("text[]", False), ("int", False), ('"public"."citext"', True), ("character varying(3)", True)])
def test_character_types(declared, expected):
    assert masking.is_character(declared) is expected


def test_rule_order():
    rules = [masking.Rule(".*", "hash_v2", algorithm="MD5"), masking.Rule(".*", "mask", length=2), masking.Rule("a\\.b\\.c", "truncate", length=1)]
    assert masking.rule_for(rules, ["A.B.C"]).kind == "truncate"
    assert masking.rule_for(rules, ["x.y.z"]).kind == "mask"
    assert masking.rule_for(rules[2:], ["a.b.cc"]) is None


@given(st.dictionaries(st.text(max_size=5), st.one_of(st.none(), st.text(max_size=8)), max_size=4))
def test_hstore_round_trip(d):
    quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    text = ", ".join(f"{quoted(k)}=>{'NULL' if v is None else quoted(v)}" for k, v in d.items())
    assert types_pg.parse_hstore(text) == dict(sorted(d.items()))


def _array_text(a):
    return "{" + ",".join("NULL" if x is None else _array_text(x) if isinstance(x, list) else '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' for x in a) + "}"


@given(st.recursive(st.lists(st.one_of(st.none(), st.text(max_size=6)), max_size=4), lambda inner: st.lists(inner, min_size=1, max_size=3), max_leaves=8))
def test_array_round_trip(a):
    assert types_pg.parse_array(_array_text(a)) == a


@pytest.mark.parametrize("bad", ["", "{", "{a", "a}", '{"a}', "{a}}"])
def test_malformed_arrays(bad):
    assert types_pg.parse_array(bad) is None


def test_redo_statements():
    assert types_oracle.parse_redo("insert into T(A,B) values ('x,y', TO_DATE('1','2'))") == {"A": "x,y", "B": "TO_DATE('1','2')"}
    assert types_oracle.parse_redo("""update T set "A" = 'p AND q' where "B" = '1' and "C" = 2""") == {"A": "p AND q", "B": "1", "C": 2}
    assert types_oracle.parse_redo("create table t(a int)") is None
    assert types_oracle.literal("1.5e3") == 1500.0 and types_oracle.literal("SYSDATE") == "SYSDATE" and types_oracle.literal("null") is None


def test_extended_json():
    assert types_doc.plain({"_id": {"$oid": "ab"}, "d": {"$date": {"$numberLong": "1700000000123"}}, "n": {"$numberDecimal": "1.50"}, "u": {"$undefined": True}, "r": {"$regularExpression": {"pattern": "x", "options": ""}}}) == {
        "_id": "ab", "d": "2023-11-14T22:13:20.123Z", "n": "1.50", "r": "x", "u": None,
    }


def test_json_diffs():
    assert json_diff.apply_diffs('{"a":[{"b":1}]}', '[{"op":"replace","path":"$.a[0].b","value":2}]') == '{"a":[{"b":2}]}'
    assert json_diff.apply_diffs('{"a":1}', '[{"op":"insert","path":"$.a","value":2}]') is None
    assert json_diff.apply_diffs("[1]", '[{"op":"remove","path":"$[3]"}]') is None


def test_field_numbers():
    assert kinds.field_number("customer-id") == 142711320
    with pytest.raises(ValueError):
        kinds.adjusted_all(["a-b", "a_b"])


VALUES = st.fixed_dictionaries({"id": st.integers(-(2**63), 2**63 - 1), "n": st.one_of(st.none(), st.integers(-(2**31), 2**31 - 1), st.text(max_size=5)), "name": st.one_of(st.none(), st.text(max_size=9)), "x": st.one_of(st.none(), st.floats(allow_nan=False)), "tags": st.one_of(st.none(), st.lists(st.one_of(st.none(), st.text(max_size=4)), max_size=4)), "h": st.one_of(st.none(), st.dictionaries(st.text(max_size=3), st.one_of(st.none(), st.text(max_size=3)), max_size=3))})
WIDE = Table("t", 1, [Field("id", "bigint", False, True), Field("n", "integer"), Field("name", "varchar(9)"), Field("x", "double precision"), Field("tags", "text[]"), Field("h", "hstore")])


@given(VALUES)
@settings(max_examples=200)
def test_avro_round_trip(row):
    schema = avro.row_schema(WIDE, "t")
    assert avro.decode(schema, avro.encode(schema, row)) == row


def test_avro_range():
    with pytest.raises(ValueError):
        avro.encode(avro.row_schema(WIDE, "t"), {"id": 1, "n": 2**40})
    assert avro.row_schema(WIDE, "t", key=True) == {"type": "record", "name": "t", "fields": [{"name": "id", "type": "long"}]}


def test_protobuf_decodes_with_the_runtime():
    pool_mod = pytest.importorskip("google.protobuf.descriptor_pool")
    from google.protobuf import descriptor_pb2, message_factory

    numbers = kinds.field_numbers([f.name for f in WIDE.fields])
    file = descriptor_pb2.FileDescriptorProto(name="t.proto", package="p", syntax="proto3")
    message = file.message_type.add(name="Value")
    column = {"id": ("int64", 3), "n": ("int32", 5), "name": ("string", 9), "x": ("double", 1)}
    for name, (_, kind) in column.items():
        inner = message.nested_type.add(name=f"{name}_column")
        inner.oneof_decl.add(name="kind")
        inner.field.add(name="value", number=1, type=kind, label=1, oneof_index=0)
        inner.field.add(name="unavailable", number=2, type=8, label=1, oneof_index=0)
        inner.field.add(name="text", number=3, type=9, label=1, oneof_index=0)
        message.field.add(name=name, number=numbers[name], type=11, label=1, type_name=f".p.Value.{name}_column")
    inner = message.nested_type.add(name="tags_column")
    inner.field.add(name="items", number=1, type=9, label=3)
    message.field.add(name="tags", number=numbers["tags"], type=11, label=1, type_name=".p.Value.tags_column")
    pool = pool_mod.DescriptorPool()
    pool.Add(file)
    kind = message_factory.GetMessageClass(pool.FindMessageTypeByName("p.Value"))
    fields = [(f.name, f.source_type) for f in WIDE.fields]
    got = kind.FromString(protobuf.encode_row(fields, {"id": -5, "n": "many", "name": "<gone>", "x": 1.5, "tags": ["a", "b"]}, "<gone>"))
    assert got.id.value == -5 and got.n.text == "many" and got.name.unavailable and got.x.value == 1.5 and list(got.tags.items) == ["a", "b"]
    assert f"id_column id = {numbers['id']};" in protobuf.definition(WIDE, "p")


def test_ddl_statements():
    h = SchemaHistory()
    h.apply("create table if not exists `a`.`b` (`id` int unsigned not null auto_increment, v varchar(5) default 'x,y', primary key (`id`), key k (v))")
    t = h.tables["a.b"]
    assert [(f.name, f.source_type, f.optional, f.primary_key) for f in t.fields] == [("id", "int unsigned", False, True), ("v", "varchar(5)", True, False)]
    h.apply("alter table b add column w int first, change v vv text not null, drop primary key", "a")
    assert [f.name for f in t.fields] != [f.name for f in h.tables["a.b"].fields] == ["w", "id", "vv"] and h.tables["a.b"].version == 2
    before = h.encode()
    with pytest.raises(ValueError):
        h.apply("alter table b add column z int, drop column nothing", "a")
    assert h.encode() == before == SchemaHistory.decode(before).encode()
    h.apply("rename table a.b to a.c")
    assert h.apply("truncate table a.c") == [] and list(h.tables) == ["a.c"]
    h.apply("drop table if exists a.c, a.d")
    assert not h.tables


def test_state_is_refused():
    with pytest.raises(ValueError):
        SchemaHistory.decode('{"format":"other","version":1,"payload":{"tables":[]}}')
    with pytest.raises(ValueError):
        SchemaHistory.decode('{"format":"tidelog.schema-history","version":9,"payload":{"tables":[]}}')


def test_relation_evolution():
    one = evolve_from_relation(None, "t", [Field("a", "int"), Field("b", "odd")], {"b"})
    two = evolve_from_relation(one, "t", [Field("a", "int"), Field("b", "odd")], {"b"}, keep_opaque=True)
    assert [f.name for f in one.fields] == ["a"] and (two.version, two.fields[1].source_type) == (2, "opaque")
    assert evolve_from_relation(two, "t", two.fields).version == 2


@pytest.mark.parametrize(("text", "amount"), [("$1,234.56", "1234.56"), ("(5.00)", "-5.00"), ("-$3", "-3.00"), ("(5", "5.00"), ("1a2", None), ("abc", None), ("$$5", None), ("--5", "-5.00"), ("1.2.3", None), ("", None), ("€.5", "0.50"), ("- 7", "-7.00"), ("$", None), ("(  $1,0 )", "-10.00")])
def test_money(spark, text, amount):
    got = spark.createDataFrame([(text,)], "t string").select(types_pg.money(F.col("t")).cast("string")).first()[0]
    assert got == amount


def test_hstore_with_many_blanks():
    assert types_pg.parse_hstore(" " * 50_000 + '"a"' + " " * 50_000 + '=>"1"') == {"a": "1"}


@pytest.mark.parametrize("bad", ["{a,}", "{,a}", "{a,,b}", "{ }"])
def test_empty_array_elements_must_be_quoted(bad):
    assert types_pg.parse_array(bad) is None
    assert types_pg.parse_array('{"",a,NULL,null}') == ["", "a", None, "null"]
