"""SQL fragments: key parsing and canonical names for packages, archives and repositories."""

from __future__ import annotations

from pkgrisk.functions.sql import regex

# Fixed value: accepted ``name@version`` form, scoped names included.
PACKAGE_KEY = r"(?i)^(@?[a-z0-9][\w.\-]*(?:/[a-z0-9][\w.\-]*)?)@([\w.\-+]+)$"
# Fixed value: dated archive name ``YYYY-MM-DD-name-vVERSION.zip``.
DATED_ARCHIVE = r"^(\d{4}-\d{2}-\d{2})-(.+)-v([^/]+)\.zip$"
# The two supported hosts and the accepted pointer form.
REPOSITORY = {
    host: rf"(?i){host}\.com[:/]([^/]+)/([^/.]+?)(?:\.git)?/?$" for host in ("github", "gitlab")
}


def _group(col: str, pattern: str, index: int) -> str:
    """Capture group, NULL when the pattern does not match."""
    return f"IF({col} RLIKE {regex(pattern)}, regexp_extract({col}, {regex(pattern)}, {index}), NULL)"


def package_key(key: str) -> str:
    """``name@version`` → struct<package, version>, NULL fields when malformed."""
    return f"named_struct('package', {_group(key, PACKAGE_KEY, 1)}, 'version', {_group(key, PACKAGE_KEY, 2)})"


def seed_line(line: str) -> str:
    """Seed-list line: scoped names split at the last ``@``, others at the first."""
    t = f"trim({line})"

    def part(i: int) -> str:
        return (
            f"IF(contains({t}, '@'), trim(IF(startswith({t}, '@'), "
            f"regexp_extract({t}, '^(.*)@([^@]*)$', {i}), regexp_extract({t}, '^([^@]*)@(.*)$', {i}))), NULL)"
        )

    return f"named_struct('package', {part(1)}, 'version', {part(2)})"


def dated_archive(name: str) -> str:
    """Archive file name → struct<captured_date, package, version>; ``@scope@name`` becomes scoped."""
    package = f"regexp_replace({_group(name, DATED_ARCHIVE, 2)}, '^@([^@]+)@(.+)$', '@$1/$2')"
    return (
        f"named_struct('captured_date', {_group(name, DATED_ARCHIVE, 1)}, "
        f"'package', {package}, 'version', {_group(name, DATED_ARCHIVE, 3)})"
    )


def canonical(name: str, ecosystem: str) -> str:
    """Canonical package name; ``ecosystem`` is a SQL expression."""
    return (
        f"CASE {ecosystem} WHEN 'pypi' THEN lower(regexp_replace(trim({name}), '[-_.]+', '-')) "
        f"WHEN 'composer' THEN lower(trim({name})) ELSE trim({name}) END"
    )


def safe_path_token(value: str) -> str:
    """File-system safe token: other characters become ``_``, outer ``_`` stripped, never empty."""
    token = f"regexp_replace(regexp_replace({value}, '[^A-Za-z0-9._@-]+', '_'), '^_+|_+$', '')"
    return f"coalesce(nullif({token}, ''), '_')"


def note_file_name(package: str, version: str) -> str:
    return f"concat(replace(concat({package}, '@', {version}), '/', '__'), '.md')"


def _short(package: str) -> str:
    return f"IF(startswith({package}, '@'), regexp_extract({package}, '([^/]*)$', 1), {package})"


def tarball_name(package: str, version: str) -> str:
    return f"concat({_short(package)}, '-', {version}, '.tgz')"


def tarball_version(package: str, filename: str) -> str:
    """Version part of ``name-VERSION.tgz``; NULL when the name does not fit."""
    n = f"length({_short(package)})"
    return (
        f"IF(startswith({filename}, concat({_short(package)}, '-')) AND endswith({filename}, '.tgz'), "
        f"nullif(substring({filename}, {n} + 2, length({filename}) - {n} - 5), ''), NULL)"
    )


def repository(url: str) -> str:
    """Repository pointer → struct<host, owner, repo, archive_url>, NULL fields when unknown."""
    t = f"split_part(regexp_replace(trim({url}), '(?i)^git[+]', ''), '#', 1)"
    gh, gl = regex(REPOSITORY["github"]), regex(REPOSITORY["gitlab"])

    def part(i: int) -> str:
        return f"CASE WHEN {t} RLIKE {gh} THEN regexp_extract({t}, {gh}, {i}) WHEN {t} RLIKE {gl} THEN regexp_extract({t}, {gl}, {i}) END"

    return (
        f"named_struct('host', CASE WHEN {t} RLIKE {gh} THEN 'github' WHEN {t} RLIKE {gl} THEN 'gitlab' END, "
        f"'owner', {part(1)}, 'repo', {part(2)})"
    )


def archive_url(r: str) -> str:
    """Archive URL template for a ``repository`` struct column."""
    base = f"concat('https://', {r}.host, '.com/', {r}.owner, '/', {r}.repo"
    return (
        f"CASE {r}.host WHEN 'github' THEN {base}, '/archive/{{sha}}.tar.gz') "
        f"WHEN 'gitlab' THEN {base}, '/-/archive/{{sha}}/', {r}.repo, '-{{sha}}.tar.gz') END"
    )
