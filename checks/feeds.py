"""Readers, writers and streams, on data derived from the tables."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks.builders import GATE, decisions, lines
from checks.history import EVENTS, FOLD
from checks.registry import query
from checks.splits import split_sql
from checks.trees import DIFF, diff, pairs
from checks.views import VIEWS, table, view, with_views
from pkgrisk.operators import features, gate, splits, treediff
from pkgrisk.session import shared_folder
from pkgrisk.sources import archives, corpora, jsonarrays, sinks
from pkgrisk.sources import lines as jsonl
from pkgrisk.streaming import jobs


@query("parse_jsonl", "SELECT event_id AS ord, CASE WHEN event_id % 6 < 2 THEN concat('p', event_id) END AS prompt, CASE event_id % 6 WHEN 0 THEN 'c' WHEN 1 THEN event_type END AS completion FROM events WHERE event_id % 6 <> 5")
def _(spark, sf):
    return jsonl.parse_jsonl(lines(spark, sf), "prompt string, completion string", line="line")


@query(
    "jsonl_line_counts",
    "SELECT count(*) AS n_lines, count(*) FILTER (event_id % 10 = 0) AS n_blank, count(*) FILTER (event_id % 10 <> 0 AND event_id % 6 = 5) AS n_bad, count(*) FILTER (event_id % 10 <> 0 AND event_id % 6 <> 5) AS n_records FROM events",
)
def _(spark, sf):
    return jsonl.line_counts(lines(spark, sf).selectExpr("IF(ord % 10 = 0, '  ', line) AS value"))


@query(
    "parse_json_documents",
    "SELECT event_id, k FROM events, (VALUES (1), (2)) t(k) WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 9 FROM events WHERE event_id % 4 = 1",
)
def _(spark, sf):
    docs = table(spark, sf, "events").selectExpr(
        "event_id", "CASE event_id % 4 WHEN 0 THEN '[{\"k\":1}, 5, {\"k\":2}]' WHEN 1 THEN '{\"k\":9}' WHEN 2 THEN '[bad' ELSE '\"text\"' END AS value"
    )
    return jsonl.parse_json_documents(docs).selectExpr("event_id", "try_variant_get(rec, '$.k', 'int') AS k")


@query(
    "parse_seed_list",
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN concat('@s/p', o_custkey) WHEN 3 THEN NULL ELSE concat('p', o_custkey) END AS package, CASE o_orderkey % 5 WHEN 2 THEN '2' WHEN 3 THEN NULL WHEN 4 THEN '1@x' ELSE '1' END AS version, o_orderkey % 5 = 3 AS malformed FROM orders WHERE o_orderkey % 5 NOT IN (0, 1)",
)
def _(spark, sf):
    src = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN '# note' WHEN 1 THEN '  ' WHEN 2 THEN concat(' @s/p', o_custkey, '@2') WHEN 3 THEN 'nothing' ELSE concat('p', o_custkey, '@1@x') END AS value"
    )
    return jsonl.parse_seed_list(src).drop("value")


def packed_archives(docs):
    """One archive per document: the text, an escape attempt and a link; zip and tgz alternate."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                buf, body = io.BytesIO(), text.encode()
                if i % 50 == 7:
                    buf.write(b"not an archive")
                elif i % 2:
                    with zipfile.ZipFile(buf, "w") as z:
                        z.writestr("package/a.js", body)
                        z.writestr("package/../../evil.js", b"x")
                else:
                    with tarfile.open(fileobj=buf, mode="w:gz") as t:
                        for name, data in (("package/a.js", body), ("/abs.js", b"x")):
                            info = tarfile.TarInfo(name)
                            info.size = len(data)
                            t.addfile(info, io.BytesIO(data))
                        link = tarfile.TarInfo("package/l.js")
                        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
                        t.addfile(link)
                out.append(buf.getvalue())
            yield pd.DataFrame({"path": [f"arch/{i}" for i in pdf["doc_id"]], "content": out})

    return docs.select("doc_id", "text").mapInPandas(run, "path string, content binary")


@query(
    "archive_members",
    """SELECT concat('arch/', doc_id) AS archive, 'package/a.js' AS member, sha256(text) AS digest, strlen(text) AS size, NULL AS reject_reason FROM documents WHERE doc_id % 50 <> 7
      UNION ALL SELECT concat('arch/', doc_id), 'package/../../evil.js', NULL, 1, 'parent_segment' FROM documents WHERE doc_id % 2 = 1 AND doc_id % 50 <> 7
      UNION ALL SELECT concat('arch/', doc_id), '/abs.js', NULL, 1, 'absolute_path' FROM documents WHERE doc_id % 2 = 0
      UNION ALL SELECT concat('arch/', doc_id), 'package/l.js', NULL, 0, 'link' FROM documents WHERE doc_id % 2 = 0
      UNION ALL SELECT concat('arch/', doc_id), NULL, NULL, NULL, 'unreadable' FROM documents WHERE doc_id % 50 = 7""",
)
def _(spark, sf):
    out = archives.explode_archives(packed_archives(table(spark, sf, "documents")))
    return out.selectExpr("archive", "member", "sha2(content, 256) AS digest", "size", "reject_reason")


def written_archives(spark, docs):
    """Archives of 200 documents each as files in the shared folder: zip, plain and compressed tar in turn."""
    folder = shared_folder(spark, "archives")

    def write(pdf):
        from pyarrow import fs

        k = int(pdf["doc_id"].iloc[0]) // 200
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        buf = io.BytesIO()
        pdf = pdf.sort_values("doc_id")
        if k % 3 == 0:
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                for i, text in zip(pdf["doc_id"], pdf["text"]):
                    z.writestr(f"package/{i}.js", text.encode())
        else:
            with tarfile.open(fileobj=buf, mode="w" if k % 3 == 1 else "w:gz") as t:
                for i, text in zip(pdf["doc_id"], pdf["text"]):
                    info = tarfile.TarInfo(f"package/{i}.js" if i % 9 else f"../{i}.js")
                    info.size = len(text.encode())
                    t.addfile(info, io.BytesIO(text.encode()))
        with system.open_output_stream(f"{root}/{k}.arc") as out:  # a repeated task writes the same file again
            out.write(buf.getvalue())
        return pd.DataFrame({"k": [k], "n": [len(pdf)]})

    packed = docs.select("doc_id", "text").groupBy(F.expr("doc_id DIV 200").alias("k")).applyInPandas(write, "k long, n long")
    packed.agg(F.sum("n")).collect()  # the files are there from here on
    return folder


ARRAY_FILES = """SELECT doc_id, text, doc_id // 300 AS k, doc_id // 300 % 4 = 3 AND doc_id = max(doc_id) OVER (PARTITION BY doc_id // 300) AS lost FROM documents"""


def written_arrays(spark, docs):
    """Arrays of up to 300 records as files in the shared folder; of every fourth the end is missing."""
    folder = shared_folder(spark, "arrays")

    def write(pdf):
        from pyarrow import fs

        k = int(pdf["doc_id"].iloc[0]) // 300
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        pdf = pdf.sort_values("doc_id")
        records = [{"id": int(i), "note": ['"', {"k\\": "]"}], "text": text} for i, text in zip(pdf["doc_id"], pdf["text"])]
        body = json.dumps(records, indent=k % 3 or None, ensure_ascii=k % 2 == 0)
        with system.open_output_stream(f"{root}/{k}.json") as out:  # a repeated task writes the same file again
            out.write((body.rstrip("]\n") if k % 4 == 3 else body).encode())
        return pd.DataFrame({"k": [k], "n": [len(pdf)]})

    written = docs.select("doc_id", "text").groupBy(F.expr("doc_id DIV 300").alias("k")).applyInPandas(write, "k long, n long")
    written.agg(F.sum("n")).collect()  # the files are there from here on
    return folder


@query(
    "json_array_records",
    f"""SELECT k, CASE WHEN NOT lost THEN doc_id END AS doc_id, CASE WHEN NOT lost THEN sha256(text) END AS digest,
        CASE WHEN lost THEN 'file ends inside the array' END AS problem FROM ({ARRAY_FILES})""",
)
def _(spark, sf):
    """Files that are cut at 256 KiB give every record once; one that breaks off gives all but its last."""
    out = jsonarrays.read_json_records(spark, written_arrays(spark, table(spark, sf, "documents")), 1 << 18)
    return out.selectExpr(
        "cast(regexp_extract(path, '([0-9]+)[.]json$', 1) AS bigint) AS k", "try_variant_get(rec, '$.id', 'bigint') AS doc_id",
        "sha2(try_variant_get(rec, '$.text', 'string'), 256) AS digest", "problem",
    )


@query(
    "json_array_whole_files",
    f"SELECT doc_id, sha256(text) AS digest FROM ({ARRAY_FILES}) WHERE k % 4 <> 3",
)
def _(spark, sf):
    """With whole files, one that breaks off gives nothing."""
    out = jsonarrays.read_json_records(spark, written_arrays(spark, table(spark, sf, "documents")), 1 << 18, whole_files=True)
    return out.filter("problem IS NULL").selectExpr(
        "try_variant_get(rec, '$.id', 'bigint') AS doc_id", "sha2(try_variant_get(rec, '$.text', 'string'), 256) AS digest"
    )


@query(
    "archive_ranges",
    """SELECT concat(doc_id // 200, '.arc') AS archive, CASE WHEN doc_id // 200 % 3 > 0 AND doc_id % 9 = 0 THEN concat('../', doc_id, '.js') ELSE concat('package/', doc_id, '.js') END AS member,
      strlen(text) AS size, CASE WHEN doc_id // 200 % 3 > 0 AND doc_id % 9 = 0 THEN NULL ELSE sha256(text) END AS digest,
      CASE WHEN doc_id // 200 % 3 > 0 AND doc_id % 9 = 0 THEN 'parent_segment' END AS reject_reason FROM documents""",
)
def _(spark, sf):
    folder = written_archives(spark, table(spark, sf, "documents"))
    out = archives.read_archives(spark, folder, slice_bytes=256 * 1024)
    return out.selectExpr("substring_index(archive, '/', -1) AS archive", "member", "size", "sha2(content, 256) AS digest", "reject_reason")


@query(
    "archive_parts",
    """SELECT doc_id, CAST(k AS INTEGER) AS part, least(4096, strlen(text) - k * 4096) AS n, NULL AS problem FROM documents, unnest(range(greatest(1, (strlen(text) + 4095) // 4096))) AS u(k)
      WHERE NOT (doc_id // 200 % 3 > 0 AND doc_id % 9 = 0)""",
)
def _(spark, sf):
    folder = written_archives(spark, table(spark, sf, "documents"))
    out = archives.read_archives(spark, folder, part_bytes=4096, slice_bytes=256 * 1024).filter("reject_reason IS NULL")
    return out.selectExpr("cast(regexp_extract(member, '([0-9]+)') AS bigint) AS doc_id", "part", "length(content) AS n", "problem")


@query(
    "strip_top_level",
    """SELECT archive, path FROM (SELECT doc_id // 10 AS archive, CASE WHEN doc_id // 10 % 3 = 0 AND doc_id % 10 < 5 THEN concat('f', doc_id) WHEN doc_id // 10 % 3 = 0 THEN NULL
      WHEN doc_id // 10 % 3 = 1 THEN concat('f', doc_id) ELSE concat('d', doc_id % 2, '/f', doc_id) END AS path FROM documents) WHERE path IS NOT NULL""",
)
def _(spark, sf):
    files = table(spark, sf, "documents").selectExpr(
        "doc_id DIV 10 AS archive", "CASE doc_id DIV 10 % 3 WHEN 0 THEN concat(IF(doc_id % 10 < 5, 'package', 'other'), '/f', doc_id) "
        "WHEN 1 THEN concat('repo-abc/f', doc_id) ELSE concat('d', doc_id % 2, '/f', doc_id) END AS path"
    )
    return archives.strip_top_level(files)


@query(
    "parse_policy_state",
    """SELECT state, concat('p', o_custkey, '@1') AS key, CASE WHEN state = 'blocked' THEN 'bad' END AS reason, state <> 'extra' AS known
      FROM orders, (VALUES ('blocked'), ('allowlist'), ('extra')) t(state)""",
)
def _(spark, sf):
    docs = table(spark, sf, "orders").selectExpr(
        """concat('{"blocked":{"p', o_custkey, '@1":{"reason":"bad"}},"quarantined":null,"allowlist":{"p', o_custkey, '@1":{}},"extra":{"p', o_custkey, '@1":{}}}') AS value"""
    )
    out = corpora.parse_policy_state(docs)
    return out.select("state", "key", "reason", "known")


@query(
    "ground_truth_keys",
    """SELECT 'benign_list' AS source, concat('n', c_custkey, '/1') AS key FROM customer WHERE c_custkey % 2 = 0
      UNION ALL SELECT 'tool_fp', concat('n', c_custkey, k) FROM customer, (VALUES ('/2'), ('/3')) t(k) WHERE c_custkey % 3 <> 0
      UNION ALL SELECT DISTINCT 'summary', concat('n', c_nationkey, '/4') FROM customer""",
)
def _(spark, sf):
    cust = table(spark, sf, "customer")
    ben = corpora.benign_keys(cust.selectExpr("IF(c_custkey % 2 = 0, concat(' n', c_custkey, '/1 '), 'noslash') AS value"))
    rep = corpora.report_keys(cust.selectExpr("IF(c_custkey % 3 = 0, '{broken', concat('{\"n', c_custkey, '/2\":1,\"n', c_custkey, '/3\":{}}')) AS value"), "tool_fp")
    summ = corpora.summary_keys(cust.selectExpr("concat('[{\"package_name\": \"n', c_nationkey, '\", \"version\":\"4\"}, {\"package_name\": \"trunc') AS value"))
    return ben.unionByName(rep).unionByName(summ)


@query(
    "malware_manifest",
    "SELECT concat('p', p_partkey) AS package, CASE WHEN p_partkey % 2 = 0 THEN concat('1.', p_size, ',2') END AS versions FROM part",
)
def _(spark, sf):
    docs = table(spark, sf, "part").selectExpr("concat('{\"p', p_partkey, '\":', IF(p_partkey % 2 = 0, concat('[\"1.', p_size, '\",\"2\"]'), 'null'), '}') AS value")
    return corpora.malware_manifest(docs).selectExpr("package", "array_join(versions, ',') AS versions")


@query(
    "split_names",
    "SELECT split, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'val' WHEN 3 THEN 'dev' WHEN 4 THEN 'test' END AS split FROM events) WHERE split IS NOT NULL GROUP BY ALL",
)
def _(spark, sf):
    files = table(spark, sf, "events").selectExpr("concat('x/', element_at(array('Train', 'validation', 'val', 'dev', 'test', 'other'), cast(event_id % 6 + 1 AS int)), '.jsonl') AS file_name")
    return corpora.split_names(files).groupBy("split").agg(F.expr("count(*) AS n"))


@query("write_jsonl", "SELECT doc_id, lang, n_chars FROM documents")
def _(spark, sf):
    path = shared_folder(spark, "jsonl")
    jsonl.write_jsonl(table(spark, sf, "documents"), path, drop=["text", "source"])
    return jsonl.read_jsonl(spark, path, "doc_id bigint, lang string, n_chars bigint")


@query("write_features", "SELECT concat('pkg', doc_id) AS package_name, length(concat('pkg', doc_id)) AS package_name_length FROM documents")
def _(spark, sf):
    path = shared_folder(spark, "features") + ".parquet"
    sinks.write_features(features.extract_features(view(spark, sf, "records")), path)
    return corpora.read_features(spark, path).select("package_name", "package_name_length")


@query("features_twin", "SELECT concat('pkg', doc_id) AS package_name, length(concat('pkg', doc_id)) AS package_name_length FROM documents")
def _(spark, sf):
    """Features that lie as JSON lines next to the asked Parquet path."""
    path = shared_folder(spark, "twin")
    jsonl.write_jsonl(features.extract_features(view(spark, sf, "records")).select("package_name", "package_name_length"), path + ".jsonl")
    return corpora.read_features(spark, path + ".parquet")


@query(
    "write_splits",
    f"WITH s AS ({split_sql('floor', 0.8, 0.1, 'lang')}) SELECT split, lang AS label, source, count(*) AS n FROM documents JOIN s USING (doc_id) GROUP BY GROUPING SETS ((split), (split, lang), (split, source))",
)
def _(spark, sf):
    df = splits.stratified_split(table(spark, sf, "documents"), ["lang"], "doc_id", 0.8, 0.1)
    return sinks.write_splits(df.selectExpr("doc_id", "split", "lang AS label", "source"), shared_folder(spark, "splits"))


@query("write_pairs", DIFF + "SELECT case_id, 'unknown' AS severity, count(*) AS n_files_changed FROM d GROUP BY case_id")
def _(spark, sf):
    path = shared_folder(spark, "pairs")
    stored = treediff.pair_manifest(pairs(spark, sf), diff(spark, sf)).selectExpr("*", "cast(NULL AS string) AS severity", "cast(NULL AS array<string>) AS advisory_ids")
    skipped = stored.withColumn("status", F.lit("skipped_same_version"))
    found = stored.unionByName(skipped)
    broken = diff(spark, sf).withColumn("path", F.expr("IF(path IS NULL, path, raise_error('lost executor'))"))
    try:  # the second of the two tables fails: nothing of this attempt may be seen
        sinks.write_pairs(found, broken, path)
    except PySparkException as e:
        assert "lost executor" in str(e)
    for _ in range(2):  # repeated, and repeated again after it was committed
        sinks.write_pairs(found, diff(spark, sf), path)
    return corpora.read_pairs(spark, path).select("case_id", "severity", "n_files_changed")


@query("append_audit", with_views("audit") + "SELECT event_id, status FROM audit")
def _(spark, sf):
    path, audit = shared_folder(spark, "audit"), view(spark, sf, "audit").select("event_id", "status")
    for part in (0, 1, 1):
        sinks.append_audit(audit.filter(f"event_id % 2 = {part}"), path, f"part {part}")
    return sinks.read_audit(spark, path)


@query(
    "decision_counters",
    with_views("audit") + "SELECT CAST(date_trunc('hour', ts) AS STRING) AS window_start, CASE status WHEN 200 THEN 'allow' WHEN 202 THEN 'quarantine' WHEN 451 THEN 'block' ELSE 'not-found' END AS decision, count(*) AS n FROM audit GROUP BY ALL",
)
def _(spark, sf):
    out = jobs.decision_counters(gate.decode_status(view(spark, sf, "audit")))
    return out.selectExpr("cast(window_start AS string) AS window_start", "decision", "n")


def event_stream(spark, sf, sql):
    """The events table as a file stream, seen through one of the views."""
    path = f"{sf}/events.parquet"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The pattern form lets the stream take a single file or a folder of files alike.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/event[s].parquet")
    stream.createOrReplaceTempView("events")
    bound = spark.sql(sql)
    spark.catalog.dropTempView("events")
    return bound


def finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query("stream_gate", GATE + "SELECT event_id, package, decision FROM g")
def _(spark, sf):
    out, ck = shared_folder(spark, "gate"), shared_folder(spark, "gate-ck")
    finish(jobs.gate_stream(event_stream(spark, sf, VIEWS["scan"]), lambda: decisions(spark, sf), out, ck))
    return spark.read.parquet(out).select("event_id", "package", "decision")


@query(
    "stream_gate_policy",
    GATE + "SELECT event_id, package, CASE WHEN event_id % 2 = 0 THEN decision ELSE 'not-found' END AS decision FROM g",
)
def _(spark, sf):
    """Two micro-batches of one stream; between them the policy is withdrawn, which the second one sees."""
    source, out, ck = shared_folder(spark, "scan"), shared_folder(spark, "gated"), shared_folder(spark, "gated-ck")
    scan = view(spark, sf, "scan")
    for part, known in ((0, decisions(spark, sf)), (1, decisions(spark, sf).limit(0))):
        scan.filter(f"event_id % 2 = {part}").write.mode("append").parquet(source)
        finish(jobs.gate_stream(spark.readStream.schema(scan.schema).parquet(source), lambda known=known: known, out, ck))
    return spark.read.parquet(out).select("event_id", "package", "decision")


@query(
    "stream_counters",
    with_views("audit")
    + """SELECT CAST(date_trunc('hour', ts) AS STRING) AS window_start, CASE status WHEN 200 THEN 'allow' WHEN 202 THEN 'quarantine' WHEN 451 THEN 'block' ELSE 'not-found' END AS decision, count(*) AS n
      FROM audit GROUP BY ALL""",
)
def _(spark, sf):
    out, ck = shared_folder(spark, "counters"), shared_folder(spark, "counters-ck")
    finish(jobs.counters_stream(gate.decode_status(event_stream(spark, sf, VIEWS["audit"])), out, ck))
    return jobs.latest_counters(spark, out).selectExpr("cast(window_start AS string) AS window_start", "decision", "n")


@query("stream_first_seen", with_views("audit") + "SELECT package, version, min(event_id) AS event_id FROM audit GROUP BY ALL")
def _(spark, sf):
    out, ck = shared_folder(spark, "seen"), shared_folder(spark, "seen-ck")
    finish(jobs.first_seen_stream(spark, event_stream(spark, sf, VIEWS["audit"]), out, ck, "event_id"))
    return jobs.first_seen(spark, out).select("package", "version", "event_id")


@query(
    "stream_state",
    FOLD
    + """SELECT l.key, 'blocked' AS state, ok.reason FROM l JOIN ok ON ok.key = l.key AND ok.rn = rb
      UNION ALL SELECT l.key, 'quarantined', ok.reason FROM l JOIN ok ON ok.key = l.key AND ok.rn = rq WHERE rp IS NULL OR rq > rp
      UNION ALL SELECT l.key, 'allowlist', ok.reason FROM l JOIN ok ON ok.key = l.key AND ok.rn = ra""",
)
def _(spark, sf):
    out, ck = shared_folder(spark, "state"), shared_folder(spark, "state-ck")
    finish(jobs.state_stream(spark, event_stream(spark, sf, EVENTS), out, ck, "3650 days"))
    return jobs.latest_state(spark, out).select("key", "state", "reason")
