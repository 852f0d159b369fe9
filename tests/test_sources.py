"""Readers and writers on small files, and streams over several files."""

import io
import json
import os
import tarfile
import zipfile

import pytest

from pkgrisk.operators import builders, gate, history
from pkgrisk.sources import advisories, archives, corpora, lines
from pkgrisk.streaming import jobs


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_modes(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"a":1}\n\n  {"a":2}  \nbroken\n[1]\n')
    assert sorted(r.a for r in lines.read_jsonl(spark, p, "a int").collect()) == [1, 2]
    assert lines.read_jsonl(spark, p).count() == 3
    with pytest.raises(Exception, match="bad JSON line"):
        lines.read_jsonl(spark, p, mode="strict").collect()


def test_json_array_or_object(spark, tmp_path):
    write(tmp_path / "d" / "a.json", '[{"k":1}, 3,\n {"k":2}]')
    write(tmp_path / "d" / "b.json", '{"k":\n3}')
    got = lines.read_json_array(spark, str(tmp_path / "d")).selectExpr("try_variant_get(rec, '$.k', 'int') AS k").collect()
    assert sorted(r.k for r in got) == [1, 2, 3]


def test_seed_list(spark, tmp_path):
    p = write(tmp_path / "s.txt", "# c\n\nlodash@4.17.21\n@scope/n@1.0.0\nnope\n")
    got = {(r.package, r.version, r.malformed) for r in lines.read_seed_list(spark, p).collect()}
    assert got == {("lodash", "4.17.21", False), ("@scope/n", "1.0.0", False), (None, None, True)}


def tgz(members):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return buf.getvalue()


def test_archives(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.tgz").write_bytes(tgz([("package/x.js", b"1"), ("../y", b"2"), ("package/big", b"z" * 99)]))
    with zipfile.ZipFile(tmp_path / "in" / "b.zip", "w") as z:
        z.writestr("repo-1/m.js", "3")
        z.writestr("/abs", "4")
    (tmp_path / "in" / "huge.tgz").write_bytes(b"0" * 5000)
    got = {r.member: (r.reject_reason, r.content) for r in archives.read_archives(spark, str(tmp_path / "in"), 4000, 50).collect()}
    assert got["package/x.js"] == (None, b"1") and got["../y"] == ("parent_segment", None)
    assert got["package/big"] == ("too_large", None) and got["/abs"][0] == "absolute_path" and got[None] == ("too_large", None) and len(got) == 6
    whole = {r.member: r.reject_reason for r in archives.read_archives(spark, str(tmp_path / "in")).collect()}
    assert whole["package/big"] is None and whole[None] == "unreadable"


def test_package_tree_strips_the_top_folder(spark, tmp_path):
    write(tmp_path / "t" / "one" / "package" / "a.js", "1")
    write(tmp_path / "t" / "two" / "only" / "b" / "c.js", "2")
    got = {(r.archive, r.path) for r in archives.read_package_tree(spark, str(tmp_path / "t")).collect()}
    assert got == {("one", "a.js"), ("two", "b/c.js")}


def test_policy_state_rejects_wrong_types(spark, tmp_path):
    good = write(tmp_path / "p.json", json.dumps({"blocked": {"a@1": {"reason": "r"}}, "quarantined": None, "extra": {"b@1": {}}}))
    got = {(r.state, r.key, r.known) for r in corpora.read_policy_state(spark, good).collect()}
    assert got == {("blocked", "a@1", True), ("extra", "b@1", False)}
    with pytest.raises(Exception, match="not an object"):
        corpora.read_policy_state(spark, write(tmp_path / "q.json", '{"blocked":[1]}')).collect()


def test_ground_truth_files(spark, tmp_path):
    write(tmp_path / "g" / "benign.txt", "@s##n/1.0\nnoslash\n")
    for name, keys in (("benign", ["a/1"]), ("malicious", ["b/1"]), ("false_positives", []), ("false_negatives", ["a/1"])):
        write(tmp_path / "g" / "tool" / f"{name}.json", json.dumps(dict.fromkeys(keys, 1)))
    write(tmp_path / "g" / "summary.json", '[{"package_name": "c", "version": "2"}, {"package_name": "cut')
    from pkgrisk.operators.labels import build_ground_truth

    got = {(r.name, r.version, r.label) for r in build_ground_truth(corpora.read_ground_truth(spark, str(tmp_path / "g"))).collect()}
    assert got == {("@s##n", "1.0", 0), ("a", "1", 1), ("b", "1", 1), ("c", "2", 1)}


def test_malware_corpus(spark, tmp_path):
    for p in ("malicious_intent/x/2020-01-02-evil-v1.0.zip", "compromised_lib/y/2020-01-03-@s@lib-v2.zip"):
        write(tmp_path / "m" / p, "zip")
    write(tmp_path / "m" / "manifest.json", '{"evil": null, "@s/lib": ["2"]}')
    listing, manifest = corpora.read_malware_corpus(spark, str(tmp_path / "m"))
    got = {(r.package, r.version, r.intent_class) for r in listing.collect()}
    assert got == {("evil", "1.0", "malicious_intent"), ("@s/lib", "2", "compromised_lib")}
    assert {r.package: r.versions for r in manifest.collect()} == {"evil": None, "@s/lib": ["2"]}


def test_osv_files(spark, tmp_path):
    write(tmp_path / "o" / "x" / "1.json", '{"id":"MAL-1",\n"affected":[]}')
    write(tmp_path / "o" / "2.json", "{broken")
    write(tmp_path / "o" / "3.json", '{"id":"MAL-3","affected":"odd"}')
    assert {r.id for r in advisories.read_osv(spark, str(tmp_path / "o")).collect()} == {"MAL-1", "MAL-3"}


def test_packuments(spark, tmp_path):
    p = write(tmp_path / "p.jsonl", '{"name":"a","versions":{"1":{}}}\nbad\n')
    assert corpora.read_packuments(spark, p).count() == 1


def test_split_directory(spark, tmp_path):
    for name in ("train", "val", "other"):
        write(tmp_path / "s" / f"{name}.jsonl", '{"a":1}\n')
    assert {r.split for r in corpora.read_splits(spark, str(tmp_path / "s")).collect()} == {"train", "val"}
    write(tmp_path / "one" / "train.jsonl", '{"a":1}\n')
    with pytest.raises(ValueError):
        corpora.read_splits(spark, str(tmp_path / "one"))


def test_split_directory_with_arrays_and_tables(spark, tmp_path):
    write(tmp_path / "s" / "train.json", '[{"a":1},\n{"a":2}]')
    write(tmp_path / "s" / "test.json", '{"a":3}')
    write(tmp_path / "s" / "dev.jsonl", '{"a":4}\nbad\n')
    spark.range(5, 7).selectExpr("id AS a").coalesce(1).write.parquet(str(tmp_path / "p"))
    part, = [p for p in os.listdir(tmp_path / "p") if p.endswith(".parquet")]
    (tmp_path / "s" / "validation.parquet").write_bytes((tmp_path / "p" / part).read_bytes())
    got = corpora.read_splits(spark, str(tmp_path / "s")).selectExpr("split", "variant_get(rec, '$.a', 'int') AS a").collect()
    assert {(r.split, r.a) for r in got} == {("train", 1), ("train", 2), ("test", 3), ("dev", 4), ("validation", 5), ("validation", 6)}


def test_features_twin(spark, tmp_path):
    write(tmp_path / "f.jsonl", '{"x":1}\n')
    assert corpora.read_features(spark, str(tmp_path / "f.parquet")).count() == 1


def test_unknown_shape_refuses(spark):
    df = spark.createDataFrame([(1, '{"foo":"bar"}')], "ord int, line string")
    assert builders.detect_shape(df).first().shape == "unknown"
    with pytest.raises(ValueError):
        builders.normalize_chat(df, "unknown")


SCAN = [("package", "npm", f"p{i}", "", "1.0.16" if i == 0 else "1.0", "s", "high") for i in range(8)] + [
    ("package", "pypi", "x", "", "1", "s", "high"), ("package", "npm", "", "", "1", "s", "low"), ("summary", "npm", "p1", "", "1", "s", "low")]
FIELDS = ("record_type", "ecosystem", "normalized_name", "package_name", "version", "source_file", "confidence")


def test_gate_stream_equals_batch_over_several_files(spark, tmp_path):
    for i, part in enumerate((SCAN[:4], SCAN[4:8], SCAN[8:])):
        write(tmp_path / "in" / f"{i}.json", "\n".join(json.dumps(dict(zip(FIELDS, r))) for r in part) + "\nbroken\n")
    rows = [(f"p{i}", "1.0.16" if i == 0 else "1.0", "block" if i == 0 else "allow", ["release_age"] if i == 0 else []) for i in range(7)]
    known = spark.createDataFrame(rows, "package string, version string, verdict string, failed_rules array<string>")
    calls = []

    def decisions():
        calls.append(1)
        return known

    stream = jobs.read_scan_stream(spark, str(tmp_path / "in"), max_files=1)
    q = jobs.gate_stream(stream, decisions, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {(r.package, r.decision) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(f"p{i}", "allow") for i in range(1, 7)} | {("p0", "block"), ("p7", "not-found")}
    assert got == want and len(calls) == 3  # state is read again for every micro-batch
    assert gate.gate_summary(spark.read.parquet(str(tmp_path / "out"))).first().any_block


def test_gate_stream_sees_policy_that_changes_between_batches(spark, tmp_path):
    for i in range(2):
        write(tmp_path / "in" / f"{i}.json", json.dumps(dict(zip(FIELDS, SCAN[1]))))
    policy = str(tmp_path / "policy")
    verdicts = iter(["allow", "block"])

    def decisions():
        rows = [("p1", "1.0", next(verdicts), [])]
        spark.createDataFrame(rows, "package string, version string, verdict string, failed_rules array<string>").write.mode("overwrite").parquet(policy)
        return spark.read.parquet(policy)

    stream = jobs.read_scan_stream(spark, str(tmp_path / "in"), max_files=1)
    jobs.gate_stream(stream, decisions, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.batch, r.decision) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "allow"), (1, "block")}


def test_late_events_in_a_stream_have_their_effect(spark, tmp_path):
    rows = [
        ("k", "2024-01-01 00:10:00", 2, "promote", None, None), ("k", "2024-01-01 00:05:00", 1, "add", "quarantined", "a reason long enough"),
        ("l", "2024-01-01 00:07:00", 4, "add", "blocked", "a reason long enough"), ("k", "2024-01-01 00:01:00", 0, "add", "quarantined", "the first reason given"),
        ("m", "2024-01-01 00:00:00", 5, "promote", None, None),
    ]
    df = spark.createDataFrame(rows, "key string, ts string, seq bigint, action string, state string, rationale string").selectExpr("key", "cast(ts AS timestamp) AS ts", "seq", "action", "state", "rationale")
    for i in range(len(rows)):  # five files, each a micro-batch, in the order above
        df.filter(f"seq = {rows[i][2]}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.state_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.key, r.state, r.reason) for r in jobs.latest_state(spark, str(tmp_path / "out")).collect()}
    want = {(r.key, r.state, r.reason) for r in history.fold_state(history.checked_events(df)).collect()}
    assert got == want and ("k", "allowlist", "a reason long enough") in got


def test_damaged_archives_and_members(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.js", b"fine " * 500)
        z.writestr("bad.js", bytes(range(256)) * 40)
    raw = bytearray(buf.getvalue())
    at = raw.index(b"bad.js") + 6
    raw[at:at + 60] = b"\xff" * 60
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x", b"y")
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:  # a tar that ends in an uncompressed zip is a tar
        info = tarfile.TarInfo("last.zip")
        info.size = len(inner.getvalue())
        t.addfile(info, io.BytesIO(inner.getvalue()))
    rows = [("zip", bytes(raw)), ("tar", tar.getvalue()), ("xz", b"\xfd7zXZ\x00" + b"\x01" * 50), ("gz", b"\x1f\x8b\x08" + b"\x02" * 50)]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {(r.archive, r.member): (r.reject_reason, r.content is not None) for r in archives.explode_archives(df).collect()}
    assert got[("zip", "good.js")] == (None, True) and got[("zip", "bad.js")] == ("unreadable", False)
    assert got[("tar", "last.zip")] == (None, True)
    assert got[("xz", None)] == got[("gz", None)] == ("unreadable", False)


def test_state_stream_equals_batch_over_several_files(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(90).selectExpr(
        "concat('k', id % 5) AS key", "timestamp_seconds(id * 60) AS ts", "id AS seq", "IF(id % 3 = 2, 'promote', 'add') AS action",
        "element_at(array('quarantined', 'blocked', 'allowlist'), cast(id % 7 % 3 + 1 as int)) AS state", "concat('long enough reason ', id) AS rationale",
    )
    for i in range(3):
        df.filter(F.expr(f"seq DIV 30 = {i}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.state_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.key, r.state, r.reason) for r in jobs.latest_state(spark, str(tmp_path / "out")).collect()}
    want = {(r.key, r.state, r.reason) for r in history.fold_state(history.checked_events(df)).collect()}
    assert got == want


@pytest.mark.parametrize("text", [
    '{"a":1}', '{"a":1} xx', '{"a":1} {"b":2}', '{"a":1}]', '{"a":1}}]', "[1] 2", "1, 2", "1", '"x"', "", "null", '{"a":1,}', " {\n}\n",
])
def test_json_parsing_is_strict(spark, text):
    from pkgrisk.functions.variant import parse

    try:
        json.loads(text)
        good = True
    except ValueError:
        good = False
    got = spark.createDataFrame([(text,)], "t string").selectExpr(f"{parse('t')} IS NOT NULL AS ok").first().ok
    assert got is good


def test_thresholds_and_catalog(spark, tmp_path):
    from pkgrisk.sources import config

    assert config.load_thresholds() == {"allow_below": 0.05, "block_from": 0.3}
    p = write(tmp_path / "t.yaml", "allow_below: 0.1\n")
    assert config.load_thresholds(p) == {"allow_below": 0.1, "block_from": 0.3}
    c = write(tmp_path / "c.yaml", "patterns:\n- {id: a, severity: high, files: {x.js: '// {{TOKEN}}'}}\n- {severity: low}\n")
    assert config.load_catalog(c) == {"a": {"severity": "high", "files": {"x.js": "// {{TOKEN}}"}}}
    with pytest.raises(ValueError):
        config.load_catalog(write(tmp_path / "e.yaml", "patterns: []\n"))


def test_first_seen_stream_over_several_files(spark, tmp_path):
    df = spark.range(60).selectExpr("concat('p', id % 7) AS package", "'1' AS version", "id AS event_id", "timestamp_seconds(id) AS ts")
    for i in range(3):
        df.filter(f"event_id DIV 20 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.first_seen_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.package, r.event_id) for r in jobs.first_seen(spark, str(tmp_path / "out")).collect()}
    assert got == {(f"p{i}", i) for i in range(7)}


def shuffled_files(spark, df, path, n, by):
    """``df`` as ``n`` files, one a batch, rows dealt by a hash."""
    for i in range(n):
        df.filter(f"pmod(xxhash64({by}), {n}) = {i}").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_an_earlier_row_in_a_later_batch_is_the_first(spark, tmp_path):
    df = spark.range(300).selectExpr(
        "concat('p', id % 11) AS package", "IF(id % 5 = 0, NULL, '1') AS version", "id AS event_id", "IF(id % 13 = 0, NULL, timestamp_seconds(1000 - id)) AS ts",
        "IF(id % 2 = 0, id, NULL) AS some",
    )
    stream = shuffled_files(spark, df, str(tmp_path / "in"), 5, "event_id")
    jobs.first_seen_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.package, r.version): (r.event_id, r.some) for r in jobs.first_seen(spark, str(tmp_path / "out")).collect()}
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.ts is not None, r.ts and r.ts.timestamp(), r.event_id)):
        want.setdefault((r.package, r.version), (r.event_id, r.some))
    assert got == want
    batches = [spark.read.parquet(f"{tmp_path}/out/batch={i}").count() for i in range(5)]
    assert len(want) <= sum(batches) < 150  # only rows that are earlier than the first so far


def test_shuffled_state_events_equal_the_batch_fold(spark, tmp_path):
    df = spark.range(400).selectExpr(
        "concat('k', id % 7) AS key", "timestamp_seconds(id * 60) AS ts", "id AS seq", "IF(id % 3 = 2, 'promote', 'add') AS action",
        "element_at(array('quarantined', 'blocked', 'allowlist', 'odd'), cast(xxhash64(id) % 4 + 4 as int) % 4 + 1) AS state",
        "IF(id % 10 = 0, 'short', concat('long enough reason ', id, '\\nmore')) AS rationale",
    )
    stream = shuffled_files(spark, df, str(tmp_path / "in"), 5, "seq")
    jobs.state_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {tuple(r) for r in jobs.latest_state(spark, str(tmp_path / "out")).select("key", "state", "reason", "added").collect()}
    want = {tuple(r) for r in history.fold_state(history.checked_events(df)).select("key", "state", "reason", "added").collect()}
    assert got == want and len(want) > 7
    assert jobs.late_events(spark, str(tmp_path / "out")).count() == 0
    # only the keys of a batch are written
    assert spark.read.parquet(f"{tmp_path}/out/version=4").select("key").distinct().count() == df.filter("pmod(xxhash64(seq), 5) = 4").select("key").distinct().count()


def test_events_beyond_the_bound_are_kept_apart(spark, tmp_path):
    schema = "key string, ts timestamp, seq long, action string, state string, rationale string"
    why = "a long enough reason"
    batches = [
        [("a", 1000, 1, "add", "quarantined", why), ("b", 5000, 2, "add", "allowlist", why)],
        [("a", 3000, 3, "add", "blocked", why), ("c", 10, 4, "add", "blocked", why)],
        [("a", 2950, 5, "promote", None, None), ("a", 100, 6, "add", "allowlist", why)],  # 50 seconds late, and far too late
    ]
    for i, rows in enumerate(batches):
        typed = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts long")).selectExpr("key", "timestamp_seconds(ts) AS ts", "seq", "action", "state", "rationale")
        typed.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.state_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck"), "1 minute").awaitTermination()  # restarted each time
    got = {(r.key, r.state, r.added.timestamp()) for r in jobs.latest_state(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", "blocked", 3000), ("a", "allowlist", 2950), ("b", "allowlist", 5000), ("c", "blocked", 10)}
    assert [(r.key, r.seq) for r in jobs.late_events(spark, str(tmp_path / "out")).collect()] == [("a", 6)]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
