"""Features, trees, splits, metrics, state and retention against plain restatements."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from pkgrisk.functions.text import shannon_entropy
from pkgrisk.operators import features, gate, history, metrics, ordering, selection, splits, stats, treediff


def test_dotfile_writes_brute_force(spark):
    rng = random.Random(1)
    parts = ["writeFile(", "fs.appendFileSync (", ".ssh", ".npmrc", "/etc/", "x" * 60, "é ", "createWriteStream(", "y" * 97, " ", ".bash_profile"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    call = re.compile(r"\b(?:writeFile|writeFileSync|appendFile|appendFileSync|createWriteStream)\s*\(")
    dot = re.compile("|".join(re.escape(d) for d in features.DOTFILES))
    want = [sum(bool(dot.search(t[m.end():m.end() + 200])) for m in call.finditer(t)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", F.expr(features.dotfile_writes("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(want) > 100


def test_unicode_spaces_count_like_python(spark):
    text = "eval (x) éeval(y) eval (z)"
    df = features.regex_features(spark.createDataFrame([(text,)], "text string"))
    assert df.first().n_eval_calls == len(re.findall(r"\beval\s*\(", text)) == 2


@pytest.mark.parametrize("text", ["", "a", "aab", "ab" * 50, "😀é😀x\n\n", None])
def test_entropy(spark, text):
    n = Counter(text or "")
    want = -sum(c / len(text) * math.log2(c / len(text)) for c in n.values()) if text else 0.0
    got = spark.createDataFrame([(text,)], "t string").select(F.expr(shannon_entropy("t")).alias("e")).first().e
    assert got == pytest.approx(want)


def test_manifest_features_wrong_types(spark):
    rows = ["", "nope", "[1]", '{"scripts":[]}', '{"scripts":{"install":null},"files":"a.node","bin":{"x":"y.EXE"}}', '{"_age_days":"5"}']
    df = features.manifest_features(spark.createDataFrame([(r,) for r in rows], "text string")).collect()
    assert [r.has_binary_files for r in df] == [False] * 4 + [True, False]
    assert df[4].has_install_script and df[4].install_script_length == 4 and df[5].package_age_days is None


def test_score_is_capped_and_thresholds(spark):
    text = '{"scripts":{"postinstall":"x","preinstall":"y"},"files":["a.so"]}<sep>' + "eval(a) spawn " * 9 + 'writeFile("/etc/x")' * 3
    df = features.threshold_decide(features.heuristic_score(features.extract_features(
        spark.createDataFrame([(text, "p", "1")], "text string, package_name string, version string"))))
    row = df.first()
    assert row.score == 1.0 and row.decision == "block" and "binary_files_in_package" in row.score_evidence
    edge = spark.createDataFrame([(0.0499,), (0.05,), (0.2999,), (0.3,)], "score double")
    assert [r.decision for r in features.threshold_decide(edge).collect()] == ["allow", "quarantine", "quarantine", "block"]


TREES = [
    ("full", {"index.js": "a", "lib/util.js": "b"}, {"index.js": "a", "lib/util.js": "b"}, 2, 2, True),
    ("partial", {"a.js": "a", "b.js": "b"}, {"a.js": "a", "b.js": "c"}, 2, 1, False),
    ("build", {"index.js": "a", "dist/bundle.js": "x"}, {"index.js": "a"}, 1, 1, True),
    ("stem", {"lib/thing.js": "t"}, {"src/thing.js": "t", "src/thing.ts": "u"}, 1, 1, True),
    ("stem_build_differs", {"lib/thing.js": "t"}, {"src/thing.ts": "u"}, 0, 0, None),
    ("stem_differs", {"a/thing.js": "t"}, {"src/thing.ts": "u"}, 1, 0, False),
    ("empty", {}, {}, 0, 0, None),
    ("skipped", {"package.json": "x", "README.md": "y", "a.png": "z"}, {"package.json": "q"}, 0, 0, None),
]


@pytest.mark.parametrize("name,pkg,src,compared,matched,passes", TREES)
def test_source_match_cases(spark, name, pkg, src, compared, matched, passes):
    def files(d):
        return spark.createDataFrame([("p", k, v) for k, v in d.items()], "package string, path string, content string")

    row = treediff.source_match(spark.createDataFrame([("p",)], "package string"), files(pkg), files(src)).first()
    assert (row.compared, row.matched, row.passes) == (compared, matched, passes)
    assert row.ratio == (matched / compared if compared else 1.0)


def test_diff_of_a_tree_with_itself_is_empty(spark):
    t = spark.createDataFrame([("c", "a.js", "x"), ("c", "b.js", None)], "case_id string, path string, content string")
    assert treediff.diff_trees(t, t).count() == 0


def test_large_files_are_compared_whole(spark):
    big = "x\n" * (1024 * 1024 + 1)
    a = spark.createDataFrame([("c", "a.js", big)], "case_id string, path string, content string")
    b = spark.createDataFrame([("c", "a.js", big + "y\n")], "case_id string, path string, content string")
    changes = treediff.diff_trees(a, b, with_text=True)
    row = treediff.line_counts(changes).first()
    assert (row.added_lines, row.removed_lines) == (1, 0) and not changes.first().oversize
    row = treediff.diff_trees(a, b, True, max_text_bytes=100).first()
    assert row.change_kind == "modified" and row.oversize and row.text_before == row.text_after == ""


def test_line_diff_text(spark):
    df = spark.createDataFrame([("c", "a.js", "modified", "1\n2\n3\n", "1\n2x\n3\n")], "case_id string, path string, change_kind string, text_before string, text_after string")
    row = treediff.line_diff(df).first()
    assert (row.added_lines, row.removed_lines) == (1, 1) and row.unified_diff.startswith("--- a/a.js\n+++ b/a.js\n@@ -1,3 +1,3 @@")


def test_line_diff_is_whole(spark):
    df = spark.createDataFrame([("c", "a.js", "added", "", "line of text\n" * 9000)], "case_id string, path string, change_kind string, text_before string, text_after string")
    row = treediff.line_diff(df).first()
    assert row.added_lines == 9000 and row.unified_diff.count("\n+line of text") == 9000 and "@@ -0,0 +1,9000 @@" in row.unified_diff


def test_cases_are_not_multiplied(spark):
    cases = spark.createDataFrame([("npm", "p", "1", "2", None)], "ecosystem string, package string, unpatched_version string, patched_version string, status string")
    releases = spark.createDataFrame([(e, "p", v, f"{e}{v}") for e in ("npm", "pypi") for v in ("1", "2", "2")], "ecosystem string, package string, version string, tarball string")
    row, = treediff.resolve_pairs(cases, releases).collect()
    assert (row.unpatched_url, row.patched_url, row.status) == ("npm1", "npm2", "tarball_diff")
    assert treediff.resolve_pairs(cases.drop("ecosystem"), releases).count() == 1


def test_one_gate_verdict_for_several_environments(spark):
    scan = spark.createDataFrame([("p", "1"), ("p", "9"), ("q", "1")], "package string, version string")
    rows = [("p", "1", env, v, [v]) for env, v in (("dev", "allow"), ("prod", "block"), ("preprod", "quarantine"))]
    decisions = spark.createDataFrame(rows, "package string, version string, env string, verdict string, failed_rules array<string>")
    assert sorted(r.decision for r in gate.gate_inventory(scan, decisions).collect()) == ["block", "error", "not-found"]
    assert sorted(r.decision for r in gate.gate_inventory(scan, decisions, "dev").collect()) == ["allow", "error", "not-found"]


def test_operators_start_no_job_and_keep_nothing(spark):
    files = spark.range(200).selectExpr("concat('p', id % 3) AS package", "concat(id, '.js') AS path", "repeat('x', cast(id % 50 AS int)) AS content", "cast(id AS bigint) AS size", "current_timestamp() AS mtime", "'t' AS tenant", "cast(id % 2 AS int) AS label")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "building plans only")
    try:
        history.plan_eviction(files, 500)
        splits.stratified_split(files, ["label"], "path", 0.8, 0.1)
        stats.tree_digest(files)
    finally:
        started = tracker.getJobIdsForGroup("plans")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(started) == []
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_file_bytes_are_cut_on_a_character(spark):
    got = spark.createDataFrame([("é" * 10,)], "c string").select(F.expr(selection.first_bytes("c", 5)).alias("h")).first().h
    assert got == ("é" * 10).encode()[:5].decode(errors="replace")


@pytest.mark.parametrize("rounding", ["floor", "half_even"])
def test_split_sizes_and_partition(spark, rounding):
    df = spark.range(997).selectExpr("id", "IF(id % 3 = 0, 'hot', cast(id % 5 as string)) AS s")
    out = splits.stratified_split(df, ["s"], "id", 0.7, 0.15, seed=3, rounding=rounding).collect()
    assert sorted(r.id for r in out) == list(range(997))
    f = int if rounding == "floor" else round
    for s, n in Counter(r.s for r in out).items():
        c = Counter(r.split for r in out if r.s == s)
        assert (c["train"], c["val"]) == (f(n * 0.7), f(n * 0.15))


def test_split_is_stable_and_checks_fractions(spark):
    df = spark.range(200).selectExpr("id", "'a' AS s")
    a = splits.stratified_split(df, ["s"], "id").orderBy("id").collect()
    b = splits.stratified_split(df.repartition(7), ["s"], "id").orderBy("id").collect()
    assert a == b
    with pytest.raises(ValueError):
        splits.stratified_split(df, ["s"], "id", 0.5, 0.2, 0.2)


def test_holdout_takes_at_least_one(spark):
    assert splits.holdout_split(spark.range(3), "id").filter("is_test").count() == 1


def test_folds_are_balanced(spark):
    out = splits.kfold(spark.range(103).selectExpr("id", "IF(id < 20, 1, 0) AS label"), "label", "id", 5).collect()
    sizes = Counter(r.fold for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 5
    assert set(Counter(r.fold for r in out if r.label == 1).values()) == {4}


def scored(spark, n=600, seed=2, ties=17):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        rows.append((i, y, (rng.randrange(ties) + 3 * y) / 32))
    return spark.createDataFrame(rows, "id long, label int, score double"), rows


def test_auroc_against_spark_ml(spark):
    df, rows = scored(spark)
    pos = [s for _, y, s in rows if y]
    neg = [s for _, y, s in rows if not y]
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    got = metrics.auroc(df).first().auroc
    ml = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert got == pytest.approx(brute) == pytest.approx(ml)


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert metrics.auroc(df).first().auroc is None and metrics.average_precision(df).first().average_precision is None


def test_average_precision_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.7), (0, 0.1)], "label int, score double")
    assert metrics.average_precision(df).first().average_precision == pytest.approx(1 / 3 + 2 / 3 * 3 / 4)


@pytest.mark.parametrize("n", [2, 3, 10, 11, 37, 200])
def test_conformal_threshold(spark, n):
    np = pytest.importorskip("numpy")
    df, rows = scored(spark, n)
    half = [r for r in rows[: max(1, n // 2)] if r[1] == 1]
    got = metrics.conformal_threshold(df, "id").first()
    if not half:
        assert got.threshold is None
    else:
        want = 1 - float(np.quantile([1 - r[2] for r in half], 0.9, method="higher"))
        assert got.threshold == pytest.approx(want)


def test_empty_evaluation(spark):
    df = spark.createDataFrame([], "id long, label int, score double")
    row = metrics.binary_metrics(df, 0.3).first()
    assert row.n == 0 and row.f1 == 0.0 and metrics.conformal_threshold(df, "id").first().threshold is None


@pytest.mark.parametrize("stretch", [3, 40, 1 << 17])
def test_value_prefix_with_a_hot_group(spark, stretch):
    df = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('g', id % 11) END AS g",
        "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 = 1 THEN double('nan') WHEN id % 50 = 2 THEN -double('infinity') WHEN id % 50 = 3 THEN -0.0D "
        "ELSE (id % 97 - 40) * pow(10D, id % 7 - 3) END AS k", "id % 5 AS w", "1L AS c",
    )
    got = ordering.value_prefix(df, "k", ["w", "c"], ["g"], stretch).collect()
    rows = [r for r in df.collect()]

    def place(k):
        return (0, 0) if k is None else (2, 0) if k != k else (1, k)

    assert len(got) == len({(r.g, place(r.k)) for r in rows})
    for r in got:
        own = [x for x in rows if x.g == r.g]
        below = [x for x in own if place(x.k) < place(r.k)]
        assert r.before_c == len(below) and r.before_w == sum(x.w for x in below) and r.total_c == len(own)


@pytest.mark.parametrize("stretch", [2, 1000])
def test_running_sums_of_whole_numbers(spark, stretch, monkeypatch):
    """Neighbouring, huge and negative keys; values of one stretch differ in their last bits only."""
    keys = [k for base in (0, -5, 1 << 40, -(1 << 62), (1 << 63) - 200) for k in range(base, base + 150)]
    df = spark.createDataFrame([(k, k % 3) for k in keys for _ in range(k % 2 + 1)], "k long, w long")
    got = {r.k: r.before_w for r in ordering.value_prefix(df, "k", ["w"], stretch=stretch).collect()}
    total, want = 0, {}
    for k in sorted(set(keys)):
        want[k] = total
        total += sum(x % 3 for x in keys if x == k) * (k % 2 + 1)
    assert got == want
    ranks = {"low": "1", "mid": "floor((n + 1) / 2)", "high": "n", "none": "n + 1"}
    monkeypatch.setattr(ordering.value_prefix, "__defaults__", ((), stretch, None))
    row = ordering.kth_values(df, "k", ranks).first()
    whole = sorted(k for k in keys for _ in range(k % 2 + 1))
    assert (row.n, row.low, row.mid, row.high, row.none) == (len(whole), whole[0], whole[(len(whole) + 1) // 2 - 1], whole[-1], None)


def test_budget_prune_is_exact_on_a_hot_group(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', cast(id % 50 as string)) AS g", "id", "id % 7 + 1 AS n")
    got = ordering.salted_prefix_prune(df, ["g"], "id", "n", "sum_before < 40", "id", salts=8).collect()
    rows, want = df.orderBy("id").collect(), set()
    used = Counter()
    for r in rows:
        if used[r.g] < 40:
            want.add((r.g, r.id, used[r.g]))
        used[r.g] += r.n
    assert {(r.g, r.id, r.sum_before) for r in got} == want


def objects(spark, ages, size=100):
    rows = [(f"o{i}.tgz", size, a) for i, a in enumerate(ages)]
    return spark.createDataFrame(rows, "path string, size long, age long").selectExpr("path", "size", "timestamp_seconds(1700000000 - age) AS mtime", "'t' AS tenant")


@pytest.mark.parametrize("ages,max_bytes,ratio,kept", [
    ([300, 200, 100, 50], 300, 0.5, {"o3.tgz"}), ([0, 200, 100, 50], 300, 0.5, {"o0.tgz"}), ([300, 200], 300, 0.5, {"o0.tgz", "o1.tgz"}),
    ([300, 200, 100, 50, 10], 450, 0.8, {"o2.tgz", "o3.tgz", "o4.tgz"}),
])
def test_retention(spark, ages, max_bytes, ratio, kept):
    plan = history.plan_eviction(objects(spark, ages), max_bytes, ratio).collect()
    assert {r.path for r in plan if not r.evict} == kept


def test_retention_with_equal_times(spark):
    plan = history.plan_eviction(objects(spark, [5] * 40), 1000, 0.5)
    stats_row = history.eviction_stats(plan).first()
    assert (stats_row.evicted_files, stats_row.total_bytes) == (35, 500)


def fold_python(events):
    db, bad = {"blocked": {}, "quarantined": {}, "allowlist": {}}, Counter()
    for key, _, _, action, state, why in events:
        if action == "add":
            if state not in db or len(why.strip()) < 16:
                bad[action] += 1
            else:
                db[state][key] = why.strip().split("\n")[0][:200]
        elif key in db["quarantined"]:
            db["allowlist"][key] = db["quarantined"].pop(key)
        else:
            bad[action] += 1
    return {(k, s, r) for s, d in db.items() for k, r in d.items()}, bad


@pytest.mark.parametrize("seed", [1, 2])
def test_state_fold_against_sequential(spark, seed):
    rng = random.Random(seed)
    events = []
    for i in range(400):
        action = rng.choice(["add", "promote"])
        why = rng.choice(["short", f"a reason long enough {i}\nmore"])
        events.append((f"k{min(rng.randrange(12), 4)}@1", i * 997, i, action, rng.choice(["blocked", "quarantined", "quarantined", "allowlist", "x"]), why))
    df = spark.createDataFrame(events, "key string, t long, seq long, action string, state string, rationale string").withColumn("ts", F.expr("timestamp_seconds(t)"))
    want, bad = fold_python(events)
    checked = history.checked_events(df)
    assert {(r.key, r.state, r.reason) for r in history.fold_state(checked).collect()} == want
    got_bad = {r.action: r["count"] for r in checked.filter("problem is not null").groupBy("action").count().collect()}
    assert got_bad == dict(bad)
    # Folding in three steps gives the same state.
    state = spark.createDataFrame([], "key string, state string, reason string, added timestamp")
    for lo in (0, 150, 300):
        state = history.advance_state(state, df.filter(f"seq >= {lo} and seq < {lo + 150}"))
    assert {(r.key, r.state, r.reason) for r in state.collect()} == want


def test_tree_digest(spark):
    import hashlib

    def sha(b):
        return hashlib.sha256(b).hexdigest()

    df = spark.createDataFrame([("p", "b.js", "2"), ("p", "a.js", "1"), ("q", "a", "x" * 50)], "package string, path string, content string")
    got = {r.package: r for r in stats.tree_digest(df).collect()}
    for package, own in (("p", {"a.js": b"1", "b.js": b"2"}), ("q", {"a": b"x" * 50})):
        level = {}
        for path in sorted(own):
            level.setdefault(sha(path.encode())[:4], []).append(f"{path}\0{sha(own[path])}")
        for digits in (2, 0):
            above = {}
            for name in sorted(level):
                above.setdefault(name[:digits], []).append(f"{name}:{sha(chr(10).join(level[name]).encode())}")
            level = above
        assert got[package].digest == sha("\n".join(level[""]).encode()) and got[package].fingerprint


def test_augmented_variants(spark):
    from pkgrisk.operators import augment

    files = spark.createDataFrame(
        [("p", "index.js", "a"), ("p", "postinstall.js", "old"), ("q", "index.js", "b")], "package string, path string, content string"
    )
    pk = files.select("package").distinct()
    out = augment.augment(pk, files, augment.SAMPLE_CATALOG, 3, 7).collect()
    plan = {r.variant_package: r for r in augment.plan_variants(pk, augment.SAMPLE_CATALOG, 3, 7).collect()}
    assert len(plan) == 6 and {r.variant_package for r in out} == set(plan)
    assert len({(r.variant_package, r.path) for r in out}) == len(out) and all(r.label == 1 for r in out)
    for r in out:
        assert "{{" not in r.content and "_p_" not in r.content
        if r.pattern_id == "marker-install" and r.path == "postinstall.js":
            assert plan[r.variant_package].token in r.content and "_v_" in r.content
    assert augment.augment(pk, files, augment.SAMPLE_CATALOG, 3, 7).count() == len(out)


def test_model_learns_and_fills_missing_values(spark):
    from pkgrisk.plans import model

    df = spark.range(400).selectExpr("id", "IF(id % 10 = 0, NULL, id % 50) AS x", "id % 2 = 0 AS flag", "IF(id % 50 > 25, 1, 0) AS label")
    cols = model.feature_columns(df, ["id", "label"])
    fill = model.medians(df, cols)
    xs = sorted(i % 50 for i in range(400) if i % 10)
    assert cols == ["x", "flag"] and fill["x"] == (xs[179] + xs[180]) / 2
    folds = model.cross_validate(model.feature_matrix(df, cols, fill), "id", k=2, rounds=3, depth=3).collect()
    assert len(folds) == 2 and all(f.auroc > 0.9 for f in folds) and sum(f.n_val for f in folds) == 400


def test_all_missing_column_fills_zero(spark):
    from pkgrisk.plans import model

    assert model.medians(spark.range(3).selectExpr("cast(NULL AS double) AS x"), ["x"]) == {"x": 0.0}


def test_broken_auditor_is_suspicious(spark):
    from pkgrisk.operators import responses

    def broken(batch):
        raise RuntimeError("down")

    row = responses.audit(spark.createDataFrame([("p", "x")], "package string, prompt string"), broken, ["package"]).first()
    assert (row.verdict, row.confidence) == ("suspicious", 0.0) and "RuntimeError: down" in row.problem


def test_classification_rows_respect_the_cap(spark):
    from pkgrisk.operators import builders

    pairs = spark.createDataFrame(
        [("c", "p", "1", "2", "high", ["G-1"], "{}", "{}")],
        "case_id string, package string, unpatched_version string, patched_version string, severity string, advisory_ids array<string>, slice_before string, slice_after string",
    )
    changes = spark.range(3000).selectExpr(
        "'c' AS case_id", "concat('lib/', lpad(id, 5, '0'), '.js') AS path", "'modified' AS change_kind", "1L AS added_lines", "1L AS removed_lines", "repeat('x', 200) AS unified_diff"
    )
    rows = builders.pairs_to_classification(pairs, changes).collect()
    assert all(r.text.count("# change_kind=") == 3000 and r.text.count("] lib/") == 3000 for r in rows)  # whole, unless asked otherwise
    rows = builders.pairs_to_classification(pairs, changes, max_chars=32 * 1024).collect()
    assert {r.label for r in rows} == {0, 1} and all(len(r.text) <= 32 * 1024 and r.n_files_changed == 3000 for r in rows)
    assert all("[text truncated]" in r.text for r in rows)


def test_regex_features_brute_force(spark):
    rng = random.Random(4)
    parts = ["eval (", "new Function(", "spawn", "execSync ", "fetch(", "require('got')", "require(x)", "_0x1f ", "$AB ", "a$$$b ", "é", " ", "\u0001", "x1 ", "\n", "import a from 'axios'", "9z"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    df = features.regex_features(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    got = {r.i: r for r in df.collect()}
    for i, t in enumerate(texts):
        for name, pattern in features.PATTERNS.items():
            assert got[i][name] == sum(1 for _ in re.finditer(pattern.replace("(?U)", ""), t)), (name, t)
        ids = re.findall(features.IDENTIFIER, t)
        assert got[i].mean_identifier_length == pytest.approx(sum(map(len, ids)) / len(ids) if ids else 0.0)
        calls = len(re.findall(r"require\s*\(", t)) - len(re.findall(features.STRING_REQUIRE.replace("(?U)", ""), t))
        assert got[i].n_dynamic_require == max(0, calls)


def test_entropy_of_runs_in_any_text(spark):
    rows = ["", "a", "\r\n\r\n  x", "é" * 3 + "\U0001F600" * 2, "\n" * 70000 + "ab" * 70000]
    assert "array_sort" not in shannon_entropy("t")  # its default order is a lambda run for every comparison
    got = [r.e for r in spark.createDataFrame([(t,) for t in rows], "t string").select(F.expr(shannon_entropy("t")).alias("e")).collect()]
    for t, e in zip(rows, got):
        assert abs(e + sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))) < 1e-12


def test_inventory_parses_only_lines_that_may_hold_a_key(spark):
    rows = [
        ("d/a.JSONL", '{"prompt":1,"x":2}\nbad "prompt"\n\n{"x":{"answer":1}}\n[{"input":1}]\n{"messa\\u0067es":[]}'), ("b.ndjson", None), ("b.json", '{"prompt":1}'),
        ("x/manifest.json", "{}"), (None, "x"), ("c.tar.gz", ""), ("d/e/", "x"), ("\n.jsonl", '{"output": 1} {"input": 1}\n{"output":1}'),
    ]
    files = spark.createDataFrame(rows, "path string, content string")
    got = {r.path: (r.kind, r.size_bytes, r.training_keys) for r in stats.build_inventory(files).collect()}
    assert got == {
        "d/a.JSONL": ("jsonl", len(rows[0][1]), ["messages", "prompt"]), "b.ndjson": ("ndjson", None, None), "b.json": ("json", 12, []),
        "c.tar.gz": ("archive", 0, []), "d/e/": ("unknown", 1, []), "\n.jsonl": ("jsonl", len(rows[7][1]), ["output"]),
    }
    plan = stats.build_inventory(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.upper() and plan.count("substring_index") <= 2  # a name is taken once, not for every suffix


def test_rows_of_one_large_stratum_meet_its_cuts_in_many_tasks(spark):
    df = spark.range(2000).selectExpr("cast(id AS string) AS id", "0 AS label")
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        parts = splits.kfold(df, "label", "id", 4).selectExpr("spark_partition_id() AS p", "fold").groupBy("p").count().collect()
    finally:
        for k in held:
            spark.conf.unset(k)
    assert sum(r["count"] for r in parts) == 2000 and max(r["count"] for r in parts) < 1000


def test_settled_folds_shuffle_no_rows(spark):
    df = spark.range(3000).selectExpr("cast(id % 2900 AS string) AS id", "IF(id % 7 = 0, NULL, cast(id % 3 AS int)) AS label").repartition(3)
    settled = splits.kfold(df, "label", "id", 5, settled=True)
    plan = settled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    lazy = splits.kfold(df, "label", "id", 5)
    assert Counter(map(tuple, settled.collect())) == Counter(map(tuple, lazy.collect())) and settled.columns == lazy.columns


def test_large_tables_are_cross_validated_without_a_shuffle_of_rows(spark, monkeypatch):
    from pkgrisk.plans import model

    df = spark.range(4000).selectExpr("cast(id AS string) AS id", "id % 50 AS x", "IF(id % 50 > 25, 1, 0) AS label")
    matrix = model.feature_matrix(df, ["x"], {"x": 0.0}).select("id", "label", "features")
    monkeypatch.setattr(model, "PART_ROWS", 300)
    want = {r.fold: r for r in model.cross_validate(matrix, "id", k=2, rounds=2, depth=2).collect()}
    monkeypatch.setattr(model, "DEALT_ROWS", 1000)
    seen, train, held = [], model.train, spark.conf.get("spark.sql.files.openCostInBytes")
    monkeypatch.setattr(model, "train", lambda rows, *a, **b: seen.append(rows) or train(rows, *a, **b))
    got = {r.fold: r for r in model.cross_validate(matrix, "id", k=2, rounds=2, depth=2).collect()}
    assert {k: (r.n_val, r.n_pos) for k, r in got.items()} == {k: (r.n_val, r.n_pos) for k, r in want.items()} and len(got) == 2
    assert all(r.auroc > 0.9 for r in got.values())
    for rows in seen:  # one file a part, none above PART_ROWS, without the key
        parts = rows.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) >= 14 and max(r["count"] for r in parts) <= 300 and rows.columns == ["label", "features", "fold"]
    assert spark.conf.get("spark.sql.files.openCostInBytes") == held


def test_segments_keep_rows_without_an_order(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", None)], "s string, h string")
    got = ordering.hash_segments(df, ["s"], "h", "array(1L)", "seg").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"a": 2, "b": 1}


def test_texts_are_compared_a_few_at_a_time():
    import pyarrow as pa

    texts = ["a\n" * 300_000, None, "", "b\n" * 900_000, "c"] * 3
    batch = pa.RecordBatch.from_pydict({"text_before": pa.array(texts), "text_after": pa.array(texts[::-1])})
    pieces = list(treediff._pieces(batch))
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch])) and len(pieces) > 5
    assert list(treediff._pieces(batch.slice(0, 0))) == []


def test_features_are_computed_once_for_a_fit(spark):
    from pkgrisk.plans import model

    seen = spark.sparkContext.accumulator(0)

    def costly(i):
        seen.add(1)
        return float(i % 17)

    df = spark.range(200).selectExpr("cast(id AS string) AS id", "cast(id % 2 AS int) AS label", "id AS i")
    df = df.withColumn("x", F.udf(costly, "double")("i")).select("id", "label", "x")
    fitted = model.fit(df, ["x"], "id", k=0, rounds=2, depth=2)
    assert seen.value == 200 and fitted.fill == {"x": 8.0}
