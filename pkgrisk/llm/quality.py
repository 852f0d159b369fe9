"""Quality rules learnt from labelled statistics and applied as ordered Spark conditions.

Every text is described by counts and shares, computed with SQL functions only. From a bounded sample of labelled
documents sequential covering learns a decision list against the poor ones: a rule grows by the threshold that gains
most, is pruned on examples kept apart, and is taken while it is precise enough; the examples it covers are removed.
The list becomes one CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: labelled documents of each class that rules are learnt from, at most
SAMPLE = 4000
MAX_CONDITIONS = 4
MAX_RULES = 20
#: share of truly poor documents that a rule must reach among the examples kept apart, and how many of them at least
PRECISION = 0.85
SUPPORT = 4
WINDOW = 8

_SPACE = r"[\\x20\\x09-\\x0D]"
_SOLID = r"[^\\x20\\x09-\\x0D]"

# columns whose shares and values the rules may use
FEATURES = {
    "words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def bound(value: str, name: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` is ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(hashes: str) -> str:
    """SQL for the number of words in windows that occur twice or more, from the array of word hashes."""
    windows = f"transform(sequence(1, size({hashes}) - {WINDOW - 1}), i -> xxhash64(slice({hashes}, i, {WINDOW})))"
    ordered = "array_sort(transform(w, (x, i) -> struct(x AS h, i AS i)))"
    again = (
        "array_sort(transform(filter(s, (x, k) -> (k > 0 AND s[k - 1].h = x.h) OR (k < size(s) - 1 AND s[k + 1].h = x.h)), x -> x.i))"
    )
    covered = f"aggregate(transform(a, (x, k) -> if(k = size(a) - 1, {WINDOW}, least({WINDOW}, a[k + 1] - x))), 0, (n, x) -> n + x)"
    count = bound(ordered, "s", bound(again, "a", covered))
    return f"if(size({hashes}) < {WINDOW}, 0, {bound(windows, 'w', f'if(size(array_distinct(w)) = size(w), 0, {count})')})"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every text; a null text is an empty one."""
    def without(chars: str) -> Column:
        return F.length(F.translate("text", chars, ""))

    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    lines = f"filter(split(text, '\\n', -1), l -> l RLIKE '{_SOLID}')"
    # hashes of the words, made once and bound to a name for all that follows
    words = f"transform(array_remove(split(text, '{_SPACE}+', -1), ''), x -> xxhash64(x))"
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .select(
            "doc_id",
            F.expr(bound(words, "h", f"struct(size(h) AS n, size(array_distinct(h)) AS n_distinct, {_repeat_words('h')} AS repeated)")).alias("of_words"),
            F.expr(bound(lines, "l", "struct(size(l) AS n, size(l) - size(array_distinct(l)) AS again)")).alias("of_lines"),
            without(" \t\n\x0b\f\r").alias("word_chars"), F.length("text").alias("chars"), without("#*$%&|<>").alias("plain"),
            without(upper).alias("not_upper"), without(digits).alias("not_digits"), without("!?").alias("not_marks"),
        )
        .select(
            "doc_id", F.col("of_words.n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
            (F.col("chars") - F.col("plain")).cast("long").alias("n_symbols"), F.col("of_lines.again").cast("long").alias("n_dup_lines"),
            F.col("of_words.repeated").cast("long").alias("n_repeat_words"), F.col("of_words.n_distinct").cast("long").alias("n_distinct"),
            F.col("of_lines.n").cast("long").alias("n_lines"), (F.col("chars") - F.col("not_upper")).cast("long").alias("n_upper"),
            (F.col("chars") - F.col("not_digits")).cast("long").alias("n_digits"), (F.col("chars") - F.col("not_marks")).cast("long").alias("n_marks"),
        )
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > self.value if self.above else x <= self.value

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], poor: np.ndarray) -> Rule:
    """Conditions by FOIL's gain until no good document is covered or nothing is gained."""
    rule: list[Condition] = []
    inside = np.ones(len(poor), bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = int((inside & poor).sum()), int((inside & ~poor).sum())
        if n0 == 0 or p0 == 0:
            break
        base, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-6
        for name, values in x.items():
            here, y = values[inside], poor[inside]
            order = np.argsort(here, kind="stable")
            here, y = here[order], y[order]
            p, n = np.cumsum(y), np.cumsum(~y)
            cuts = np.flatnonzero(here[1:] > here[:-1])
            if not len(cuts):
                continue
            for above, a, b in ((False, p[cuts], n[cuts]), (True, p0 - p[cuts], n0 - n[cuts])):
                g = a * (np.log2(np.maximum(a, 1e-9) / np.maximum(a + b, 1)) - base)
                k = int(g.argmax())
                if g[k] > gain:
                    gain, best = g[k], Condition(name, above, float((here[cuts[k]] + here[cuts[k] + 1]) / 2))
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], poor: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule that is best on other examples, its precision and the poor ones it covers."""
    best, worth, exact, support = rule, -2.0, 0.0, 0
    for k in range(len(rule), 0, -1):
        inside = covered(rule[:k], x, len(poor))
        p, n = int((inside & poor).sum()), int((inside & ~poor).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth + 1e-12:
            best, worth, exact, support = rule[:k], value, p / (p + n) if p + n else 0.0, p
    return best, exact, support


def learn_list(x: dict[str, np.ndarray], poor: np.ndarray) -> list[Rule]:
    """Ordered rules that reject. Two thirds of the examples grow rules, every third one prunes them."""
    apart = np.arange(len(poor)) % 3 == 2
    parts = [({k: v[m] for k, v in x.items()}, poor[m]) for m in (~apart, apart)]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and parts[0][1].any():
        rule = _grow(*parts[0])
        if not rule:
            break
        rule, exact, support = _prune(rule, *parts[1])
        if exact < PRECISION or support < SUPPORT:
            break
        rules.append(rule)
        left = []
        for own, y in parts:
            stay = ~covered(rule, own, len(y))
            left.append(({k: v[stay] for k, v in own.items()}, y[stay]))
        parts = left
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules from at most SAMPLE labelled documents of each class, by hash of the id; conflicting labels count as poor."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("known")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    )
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("known", F.lit(3)), "known").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionAll(part)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("known"))  # 2 × SAMPLE ids at most
    described = statistics(sample.select(F.struct("doc_id", "label").alias("doc_id"), "text"), "doc_id", "text")
    rows = described.select("doc_id.label", *[F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()]).orderBy(
        F.xxhash64("doc_id", F.lit(9)), *FEATURES
    ).limit(2 * SAMPLE).collect()
    if not rows:
        return []
    poor = np.array([r["label"] == 0 for r in rows])
    return learn_list({k: np.array([r[k] for r in rows], float) for k in FEATURES}, poor)


def verdict(rules: list[Rule]) -> Column:
    """False for what the first rule that holds rejects, else true."""
    out = None
    for rule in rules:
        every = rule[0].column()
        for c in rule[1:]:
            every = every & c.column()
        out = F.when(every, False) if out is None else out.when(every, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, fixed limits and verdict of every text.

    Empty and null texts have no words and fail. Repeated rows and null ids are passed on.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return statistics(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, learn_rules(docs, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
