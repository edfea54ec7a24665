"""Row-level behaviour of the telemetry engine."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import coerce, parse
from logloom.functions import text as tx
from logloom.operators import drift, firewall, lifecycle, mapping, normalize, rules, shadow, source_profile
from logloom.plans import golden
from logloom.plans import spec as sp
from logloom.queries import KV_SPEC
from logloom.sources import logs
from logloom.streaming import live


def one(spark, raw, make):
    return spark.createDataFrame([(raw,)], "raw string").select(make(F.col("raw")).alias("x")).first()["x"]


def pairs(found):
    return None if found is None else {e["k"]: e["v"] for e in found}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a=1 b=2 bare c=3", {"a": "1", "b": "2"}),
        ('a="x y" b=\'q\' c="un', {"a": "x y", "b": "q", "c": "un"}),
        (r'a="say \"hi\"" b=2', {"a": r"say \"hi\"", "b": "2"}),
        ("a=1 a=2", {"a": "2"}),
        ("", {}),
    ],
)
def test_kv_strict(spark, raw, want):
    assert pairs(one(spark, raw, lambda c: parse.kv_strict(c))) == want


def test_kv_profile_skips_bare_words(spark):
    assert pairs(one(spark, r'a=1, bare b="x \"y\"";c=3', parse.kv_profile)) == {"a": "1", "b": 'x "y"', "c": "3"}


def test_cef_dialects_differ(spark):
    raw = r"CEF:0|Ven\|dor|Prod|1|42|a name|5|msg=two words src=10.0.0.1"
    assert pairs(one(spark, raw, parse.cef_profile))["msg"] == "two words"
    strict = pairs(one(spark, raw, parse.cef_strict))
    assert strict["msg"] == "two" and "src" not in strict and strict["device_vendor"] == "Ven|dor"
    assert one(spark, "CEF:0|a|b|c", parse.cef_strict) is None and one(spark, "CEF:0|a|b|c|d|e|f", parse.cef_profile) is None


def test_leef_delimiters(spark):
    assert pairs(one(spark, "LEEF:2.0|V|P|1|E|x5E|a=1^b=two words", parse.leef_profile))["b"] == "two words"
    assert pairs(one(spark, "LEEF:2.0|V|P|1|E|^|a=1^b=two words", parse.leef_strict))["b"] == "two words"
    assert pairs(one(spark, "LEEF:1.0|V|P|1|E|a=1\tb=2", parse.leef_strict))["b"] == "2"


def test_syslog_fallbacks(spark):
    head = one(spark, "<13> just a body", lambda c: parse.syslog_strict(c)[0])
    assert pairs(head) == {"prival": "13", "facility": "1", "severity": "5"}
    assert one(spark, "<13> just a body", lambda c: parse.syslog_strict(c)[1]) == "just a body"
    assert pairs(one(spark, '<14>1 2024-01-01T00:00:00Z h - - - [a k="v\\"w"][b] msg', parse.syslog_profile))["sd_a_k"] == 'v"w'


def test_json_levels(spark):
    raw = '{"a":{"b":1,"c":{"d":[1,2]}},"e":"x"}'
    assert pairs(one(spark, raw, lambda c: parse.json_flat(c, parents=False))) == {"a.b": "1", "a.c.d": "[1,2]", "e": "x"}
    assert set(pairs(one(spark, raw, lambda c: parse.json_flat(c, parents=True)))) == {"a", "a.b", "a.c", "a.c.d", "e"}
    assert one(spark, "[1]", lambda c: parse.json_flat(c, parents=True)) is None


@pytest.mark.parametrize("depth", [10, 32, 100])
def test_json_flat_opens_every_level(spark, depth):
    leaf = r'{"n":1.50,"t":[1, {"u":"\u00e9\n"}],"z":null,"o":{},"b":true}'
    raw = '{"a":' * depth + leaf + "}" * depth
    path = ".".join("a" * depth)
    want = {f"{path}.n": "1.5", f"{path}.t": '[1,{"u":"é\\n"}]', f"{path}.z": None, f"{path}.o": "{}", f"{path}.b": "true"}
    assert pairs(one(spark, raw, lambda c: parse.json_flat(c, parents=False))) == want
    strict = pairs(one(spark, raw, lambda c: parse.json_flat(c, parents=True)))
    assert len(strict) == depth + 5 and want.items() <= strict.items() and set(strict) >= {".".join("a" * k) for k in range(1, depth + 1)}


def test_json_flat_in_python_is_as_in_columns(spark):
    leaves = ["1.50", "1e5", "-0.0", "1.5e-7", "12345678.25", "0.00012", "1e400", "-3", "123456789012345678901234567890", r'"\u00e9\n\"q"', '{"x" : [1, 2.50, {"y":1E+2}], "e":{}}', "null", "[]", '{"x":1,"x":2}', r'["é\U0001f642/\u000b\\u00ab"]'.replace(r"\U0001f642", "\U0001f642")]
    raws = spark.createDataFrame([(head + x + end,) for x in leaves for head, end in (('{"k": ', "}"), ('{"a":{"b":{"k": ', "}}}"))], "raw string")
    for parents in (False, True):
        for r in raws.select("raw", *(parse.json_flat(F.col("raw"), parents, levels=n).alias(f"n{n}") for n in (0, 6))).collect():
            assert r["n0"] == r["n6"] is not None, r["raw"]


@pytest.mark.parametrize(
    ("raw", "limits", "code"),
    [
        ("x" * 65_536, {}, None), ("x" * 65_537, {}, "ERR_OVERSIZED"),
        ("[" * 32 + "]" * 32, {}, None), ("[" * 33 + "]" * 33, {}, "ERR_NESTING_EXCEEDED"),
        (json.dumps({"k" * 256: 1}), {}, None), (json.dumps({"k" * 257: 1}), {}, "ERR_KEY_TOO_LONG"),
        (json.dumps({f"k{i}": 1 for i in range(512)}), {}, None), (json.dumps({f"k{i}": 1 for i in range(513)}), {}, "ERR_FIELD_LIMIT_EXCEEDED"),
        ("[,,:]", {}, "ERR_INVALID_ENCODING"), ('{"a" 1 2}', {}, "ERR_INVALID_ENCODING"), ('{"a":[1,]}', {}, "ERR_INVALID_ENCODING"), ('{"a":{}} {"b":[]}', {}, None), ('{"a":1', {}, None),
        ('{"a": nope}', {}, "ERR_INVALID_ENCODING"), ('{"a": 1e999}', {}, "ERR_INVALID_ENCODING"), ("k" * 257 + "=1", {}, "ERR_KEY_TOO_LONG"),
    ],
)
def test_gates(spark, raw, limits, code):
    assert one(spark, raw, lambda c: firewall.violation(c, firewall.Limits(**limits))) == code


def test_gate_encoding(spark):
    df = spark.createDataFrame([(bytearray(b"a=\xe2\x82"),)], "raw binary")
    assert df.select(firewall.violation(F.col("raw")).alias("x")).first()["x"] == "ERR_INVALID_ENCODING"


def test_safe_render(spark):
    assert one(spark, "\x1b[31m<a href='x'>&\x07\t", tx.safe_render) == "&lt;a href=&#39;x&#39;&gt;&amp;\\x07\t"


@pytest.mark.parametrize(("raw", "want"), [("42", 42), ("4.9", 4), ("-4.9", -4), ("5d", None), ("x", None), (" 7 ", 7)])
def test_integer(spark, raw, want):
    assert one(spark, raw, coerce.to_integer) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1.2.3.4", "1.2.3.4"), ("::ffff:1.2.3.4", "1.2.3.4"), ("2001:0db8:0:0:0:0:0:1", "2001:db8::1"), ("999.1.1.1", None), ("01.2.3.4", None), ("::1", "::1")],
)
def test_ip(spark, raw, want):
    assert one(spark, raw, coerce.to_ip) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2024-02-03T04:05:06Z", "2024-02-03T04:05:06Z"), ("2024-02-03T04:05:06.123+01:00", "2024-02-03T03:05:06Z"), ("2024-02-03 04:05:06", "2024-02-03T04:05:06Z"),
        ("Oct  1 22:14:15", "2023-10-01T22:14:15Z"), ("Oct 11 22:14:15 2020", "2020-10-11T22:14:15Z"), ("Mon, 02 Jan 2006 15:04:05 GMT", "2006-01-02T15:04:05Z"),
        ("1700000000", "2023-11-14T22:13:20Z"), ("1700000000000", "2023-11-14T22:13:20Z"), ("1700000000000000000", "2023-11-14T22:13:20Z"), ("soon", None),
    ],
)
def test_timestamp(spark, raw, want):
    assert one(spark, raw, lambda c: coerce.timestamp_text(c, 2023)) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("-", "null"), ("", "null"), ("yes", "boolean"), ("007", "string"), ("7", "integer"), ("1700000000", "integer"), ("1e5", "float"), ("::1", "ipv6"), ("fe80::1:2", "ipv6"), ("a:b", "string"), ("1.2.3.4", "ipv4"), ("a@b.co", "email"), ("[1,2]", "array"), ("{x}", "string"), ("10/Oct/2000:13:55:36 -0700", "timestamp")],
)
def test_infer(spark, raw, want):
    assert one(spark, raw, tx.infer_type) == want


def test_template(spark):
    assert one(spark, 'GET /a/b/c from 10.0.0.1 at 2024-01-01T00:00:00Z "q" 0xff 12', tx.mask) == 'GET <PATH> from <IP> at <TIMESTAMP> "<STR>" <HEX> <NUM>'
    assert one(spark, "abc", tx.template_id) == "tpl_00017862"


def test_spec_errors():
    bad = json.loads(json.dumps(KV_SPEC)) | {"extra": 1}
    bad["fields"]["ts"]["type"] = "money"
    assert sp.violations(bad) == ["unknown key extra", "fields.ts.type is unknown"]
    with pytest.raises(ValueError):
        sp.load(json.dumps(bad))
    assert sp.merge_overrides({"a": "x"}, {"a": "y", "b": "z"}, {"b": "w"}) == {"a": "x", "b": "w"}


def test_spec_apply(spark):
    df = spark.createDataFrame([('ts=bad SRC=1.2.3.4 dst=nope dpt=80 action=Permit user="u" other=1',)], "raw string")
    r = sp.apply(df, KV_SPEC).first()
    assert (r["x_src_ip"], r["x_dst_ip"], r["x_dst_port"], r["x_event_action"]) == ("1.2.3.4", None, "80", "allow")
    assert r["errors"] == ['field "ts" type conversion error', 'field "DST" type conversion error']
    assert pairs(r["unknown"]) == {"other": "1"}


def test_null_and_empty_lines(spark):
    df = spark.createDataFrame([(None,), ("",)], "raw string")
    for r in normalize.normalize(sp.apply(df, KV_SPEC)).collect():
        assert r["action"] == "unknown" and r["outcome"] == "unknown" and r["event_class"] == "SECURITY_EVENT"


def test_rules_null_safe(spark):
    e = spark.createDataFrame([("encrypt", "", "file"), (None, None, None)], "action string, outcome string, event_class string")
    got = rules.flags(e).select("det_010", "det_004").collect()
    assert [tuple(x) for x in got] == [(True, False), (False, False)]


def test_preservation_gate(spark):
    rows = spark.createDataFrame([("DET-001", True, True), ("DET-005", True, False)], "rule_id string, matched boolean, expected boolean")
    r = rules.preservation(rows).first()
    assert (r["total"], r["preserved"], r["dps"], r["certified"]) == (2, 1, 0.5, False)
    assert rules.preservation(rows.limit(0)).first()["certified"] is False


def test_similarity():
    assert mapping.similarity("Src-IP", "src_ip") == 1.0 and mapping.similarity("my_src", "src") == 0.9 and mapping.similarity("", "x") == 0.0


def test_states(spark):
    x = spark.range(1)
    s = lambda *v: x.select(drift.structural_state(*map(F.lit, v)).alias("s")).first()["s"]
    assert (s(0.0, 0.0, 0.0, 0.0, 0.0), s(0.0, 0.0, 0.0, 0.06, 0.0), s(0.03, 0.0, 0.0, 0.0, 0.0)) == ("STABLE", "SUSPECTED", "DRIFTED")


def test_p95_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    assert shadow.p95_rank(df, "v").first()["p95"] == 20.0


def test_ulid(spark):
    r = spark.range(1).select(tx.ulid(F.lit(1700000000000), F.lit("x")).alias("u")).first()["u"]
    assert len(r) == 26 and r.startswith("01HF7YAT00")


def test_ranked_without_few(spark, monkeypatch):
    """Exact ranks though only brackets of them are ordered; ties, too."""
    monkeypatch.setattr(shadow, "FEW", 50)
    values = [float(x) for x in [*range(3000), *[7] * 500, *[2999] * 40]]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    ranks = [0, 5, 300, 1700, len(values) - 1]
    assert shadow.ranked(df, "v", ranks) == [sorted(values)[r] for r in ranks]
    assert shadow.latency(df.limit(0), "v").first()["p50"] is None and shadow.p95_rank(df.limit(0), "v").first()["p95"] is None


def test_placed(spark):
    df = spark.createDataFrame([(float(x % 97), x) for x in range(500)], "t double, x long").repartition(5)
    rows = logs.placed(df, "t").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(500)) and [r["t"] for r in rows] == sorted(float(x % 97) for x in range(500))


def test_paced_stream(spark, tmp_path):
    stream = logs.paced(spark, 50, "cef").select("line", "raw")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination(6)
    query.stop()
    got = spark.read.parquet(f"{tmp_path}/rows").orderBy("line").collect()
    want = {r["line"]: r["raw"] for r in logs.load(spark, 2000, "cef").collect()}
    assert got and all(want[r["line"]] == r["raw"] for r in got)


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("t", "A", "1.1.1.1"), ("u", "B", None)], "event_time string, event_class string, src_ip string")
    logs.sink(e, "csv", f"{tmp_path}/c", limit=1)
    rows = spark.read.option("header", True).csv(f"{tmp_path}/c")
    assert rows.columns == list(logs.CSV_COLUMNS) and rows.count() == 1
    with pytest.raises(ValueError):
        logs.sink(e, "xml", f"{tmp_path}/x")
    logs.snapshot(e, "event_time", f"{tmp_path}/ring", 1)
    assert [json.loads(r["value"])["event_time"] for r in spark.read.text(f"{tmp_path}/ring").collect()] == ["u"]


def test_live_profile_of_text_files(spark, tmp_path):
    """Lines arrive in files; each batch is profiled like a source."""
    spark.createDataFrame([("a=1 b=2 c=x",), ("a=2 b=3 c=y",), ("  ",)], "value string").write.text(f"{tmp_path}/in")
    lines = spark.readStream.text(f"{tmp_path}/in").select(F.col("value").alias("raw"))
    seen = []

    def profile(batch, _):
        clean = source_profile.nonblank(batch.withColumn("line", F.monotonically_increasing_id()))
        found = source_profile.detect(clean)
        seen.append((found.name, {r["field"] for r in source_profile.field_profile(source_profile.records(clean, found)).collect()}))

    lines.writeStream.foreachBatch(profile).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert seen == [("KEY_VALUE", {"a", "b", "c"})]
    (tmp_path / "none").mkdir()
    assert live.read(spark, f"{tmp_path}/none", "a int").isStreaming


def test_source_without_lines(spark):
    lines = spark.createDataFrame([], "line long, raw string")
    found = source_profile.detect(lines)
    assert (found.name, found.confidence) == ("UNKNOWN", 0.0)


def test_csv_without_header(spark):
    lines = spark.createDataFrame([(i, f"{i},x{i},10.0.0.{i}") for i in range(9)], "line long, raw string")
    found = source_profile.detect(lines)
    assert (found.name, found.delimiter, found.headers) == ("CSV", ",", None)
    assert pairs(source_profile.records(lines, found).orderBy("line").first()["fields"]) == {"column_1": "0", "column_2": "x0", "column_3": "10.0.0.0"}


def test_golden(spark, tmp_path):
    (tmp_path / "raw").mkdir(), (tmp_path / "expected").mkdir(), (tmp_path / "parser").mkdir()
    with pytest.raises(FileNotFoundError):
        golden.load(str(tmp_path))
    (tmp_path / "metadata.json").write_text('{"min_extraction_accuracy": 0.9}')
    (tmp_path / "raw/events.raw").write_text("src=1.2.3.4 action=permit own=1\n")
    (tmp_path / "expected/events.json").write_text('{"extracted": {"src.ip": "1.2.3.4", "event.action": "allow"}, "unknown_fields": {"own": "1"}}')
    (tmp_path / "parser/parser_spec.json").write_text(json.dumps(KV_SPEC))
    fixture = golden.load(str(tmp_path))
    r = golden.validate(spark, fixture).first()
    assert (r["expected"], r["extraction_accuracy"], r["semantic_accuracy"], r["unknown_retention"], r["passed"]) == (2, 1.0, 1.0, 1.0, True)
    fixture["expected"]["extracted"]["src.ip"] = "9.9.9.9"
    assert golden.validate(spark, fixture).first()["passed"] is False
    assert {r["k"]: r["v"] for r in golden.entries_of(spark, fixture).collect()}["own"] == "1"


def test_emitters_and_generation():
    mapping_of = {"s": "src.ip", "st": "http.response.status_code"}
    own = json.loads(sp.emitted("spec", "gate", "key_value", mapping_of))
    assert sp.violations(own) == [] and own["fields"]["st"]["type"] == "integer" and own["fields"]["s"]["type"] == "ip"
    assert sp.emitted("sql", "gate", "key_value", mapping_of) == "SELECT `s` AS `src.ip`, `st` AS `http.response.status_code` FROM `gate`"
    assert sp.emitted("remap", "g", "json", {"a": "b.c"}) == ".b.c = delete(.a)" and json.loads(sp.emitted("json", "g", "json", mapping_of)) == mapping_of
    with pytest.raises(ValueError):
        sp.emitted("cobol", "g", "json", {})


def test_schema_gate(spark):
    assert lifecycle.schema_gate([])[0] is False and lifecycle.schema_gate({"parser": {"id": "x"}})[0] is False and lifecycle.schema_gate(KV_SPEC)[0] is True
    samples = spark.createDataFrame([(1, "src=1.1.1.1")], "event_id long, raw string")
    r = lifecycle.repair(samples, KV_SPEC, {"parser": {}}, "event_id").first()
    assert r["decision"] == "REJECTED" and r["shadow_state"] == "FAILED" and lifecycle.candidate_hash({}).startswith("sha256-")


def test_assistant_answers():
    good = {"candidate_id": "c", "source_format": "f", "mapped_fields": [{"raw_field": "a", "canonical_field": "b", "confidence": 1, "reasoning": ""}], "unmapped_fields": []}
    assert mapping.well_formed(good) and not mapping.well_formed([]) and not mapping.well_formed({**good, "mapped_fields": [{"raw_field": "a"}]}) and not mapping.well_formed({**good, "candidate_id": 1})


def test_enum_inversion():
    assert drift.inverted({"deny": "deny"}, {"deny": "allow"}) and not drift.inverted({"deny": "deny"}, {}) and not drift.inverted({}, {"a": "b"})


def test_onboarding_asks_for_review(spark):
    rows = [(i, f"src=10.0.0.{i} dest_thing=x{i}") for i in range(5)]
    got = {r["field"]: r for r in lifecycle.onboard(spark.createDataFrame(rows, "line long, raw string")).collect()}
    assert got["src"]["path"] == "src.ip" and got["dest_thing"]["package_status"] == "READY_FOR_REVIEW"
