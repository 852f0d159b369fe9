"""Reviewer answers: tolerant parsing, and a pluggable batch auditor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.sql import regex
from pkgrisk.functions.variant import array_at, parse
from pkgrisk.operators import features

# Phrases that mark a refusal, matched as whole words in any case.
REFUSALS = (
    "I cannot", "I can't", "I'm sorry", "I am sorry", "I cannot help", "I am not able",
    "I won't", "I will not", "against my", "not appropriate", "unable to assist",
)
REFUSAL = r"(?i)(?U)\b(?:" + "|".join(REFUSALS) + r")\b"


def parse_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``verdict, confidence, reasoning, findings, problem, refusal``.

    A code fence is stripped, the outermost braces taken, unknown verdicts read as
    suspicious, confidence defaults to 0.5 and is clamped to 0..1.
    """
    stripped = f"trim(regexp_replace({raw}, {regex(r'(?U)^\s+|\s+$')}, ''))"
    unfenced = f"IF(startswith(_t, '```'), regexp_replace(regexp_replace(_t, {regex(r'^```(?:json)?\s*')}, ''), {regex(r'\s*```$')}, ''), _t)"
    staged = (
        df.withColumn("_t", F.expr(f"coalesce({stripped}, '')"))
        .withColumn("_j", F.expr(f"nullif(regexp_extract({unfenced}, {regex(r'(?s)(\{.*\})')}, 1), '')"))
        .withColumn("_v", F.expr(parse("_j")))
    )
    problem = (
        "CASE WHEN _t = '' THEN 'empty response' WHEN _j IS NULL THEN 'no JSON object' WHEN _v IS NULL THEN 'broken JSON' END"
    )
    word = "lower(trim(try_variant_get(_v, '$.verdict', 'string')))"
    listed = array_at("_v", "$.findings")
    single = "try_variant_get(_v, '$.findings', 'string')"
    return staged.withColumns({
        "problem": F.expr(problem),
        "verdict": F.expr(f"IF({word} IN ('clean', 'suspicious', 'malicious'), {word}, 'suspicious')"),
        "confidence": F.expr(
            "IF(_v IS NULL, 0D, greatest(0D, least(1D, coalesce(try_variant_get(_v, '$.confidence', 'double'), 0.5D))))"
        ),
        "reasoning": F.expr("coalesce(trim(try_variant_get(_v, '$.reasoning', 'string')), '')"),
        "findings": F.expr(
            f"coalesce(transform({listed}, x -> try_variant_get(x, '$', 'string')), "
            f"IF(coalesce({single}, '') = '', NULL, array({single})), cast(array() AS array<string>))"
        ),
        "refusal": F.expr(f"coalesce({raw} RLIKE {regex(REFUSAL)}, false)"),
    }).drop("_t", "_j", "_v")


def audit(prompts: DataFrame, reviewer: Callable[[pd.DataFrame], list[str]], keys: list[str]) -> DataFrame:
    """Run a user-supplied batch reviewer over prompts; failures become suspicious with confidence 0.

    ``reviewer`` takes a batch of rows and returns one raw answer per row. An exception
    fails only its batch's answers, never the job.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields if f.name in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keys].copy()
            try:
                out["raw"], out["failure"] = list(reviewer(pdf)), None
            except Exception as exc:  # a broken reviewer must not stop the corpus
                out["raw"], out["failure"] = None, f"{type(exc).__name__}: {exc}"
            yield out

    answered = prompts.mapInPandas(run, f"{fields}, raw string, failure string")
    return parse_responses(answered).withColumn("problem", F.expr("coalesce(failure, problem)")).drop("failure")


def heuristic_audit(packages: DataFrame) -> DataFrame:
    """Built-in auditor: the heuristic score as a verdict, without any model."""
    scored = features.heuristic_score(features.extract_features(packages))
    return features.threshold_decide(scored).selectExpr(
        "package_name AS package", "version",
        "CASE decision WHEN 'allow' THEN 'clean' WHEN 'block' THEN 'malicious' ELSE 'suspicious' END AS verdict",
        "score AS confidence", "score_evidence AS findings",
    )
