"""Mixing sources to target weights with thresholds on a hash.

A document's place in its source is a 60-bit hash of its id, so the documents below a threshold are a fixed, nested
sample: a larger budget only adds documents. The threshold for a budget is found from histograms: tokens are summed
by source and leading hash bits, the bucket in which the budget runs out is found with running sums, and only that
bucket is divided by the next bits, until it holds one document. Rows are then taken by comparing hashes; nothing is
sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from pkgrisk.llm.shared import fresh, stored

HASH_BITS = 60
STEP_BITS = 10
WEIGHTS = (3, 1, 2)


def count_words(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id, or of the text where there is no id."""
    key = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(F.encode(key, "utf-8")), 1, 15), 16, 10).cast("long")


def share_out(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``most`` times its size and the excess is shared again."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if weights[i] * left / weight > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * left / weight
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS) -> list[Row]:
    """Source, size, target, whole copies and the budget above them; ``sizes`` has a row for each source.

    Sources are ordered by code point, null last, and take the weights in turn. The list is one row for each source of
    the mix, which is a configuration, not data.
    """
    rows = sorted(sizes.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    size = [r["source_size"] for r in rows]
    goal = share_out(size, [weights[k % len(weights)] for k in range(len(rows))], share * sum(size))
    out = []
    for r, s, t in zip(rows, size, goal):
        whole = int(t // s) if s else 0
        out.append(Row(source=r["source"], source_size=s, target=float(t), whole=whole, budget=float(t - whole * s)))
    return out


def thresholds(places: DataFrame, goals: list[Row]) -> list[Row]:
    """For each source the hash below which documents are taken once more.

    ``places``: source, hash, size. The first round reads all rows; those of its boundary buckets, one in 1024, are
    written apart, and the further rounds read only them. The driver gets one row for each source.
    """
    spark = places.sparkSession
    state = {g["source"]: {"goal": g, "low": 0, "taken": 0.0, "open": g["budget"] > 0} for g in goals}
    shift = HASH_BITS
    while shift > 0 and any(s["open"] for s in state.values()):
        width, shift = shift, shift - STEP_BITS
        known = spark.createDataFrame(
            [(k, s["low"] >> width, s["goal"]["budget"] - s["taken"]) for k, s in state.items() if s["open"]],
            "known string, upper long, budget double",
        )
        buckets = (
            places.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("known")))  # one row for each source
            .where(F.shiftright("place", width) == F.col("upper"))
            .groupBy("source", "budget", F.shiftright("place", shift).alias("bucket"))
            .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        )
        run = Window.partitionBy("source").orderBy("bucket")
        crossing = (
            buckets.withColumn("upto", F.sum("size").over(run)).where(F.col("upto") >= F.col("budget"))
            .withColumn("k", F.row_number().over(run)).where("k = 1").collect()
        )
        found = {r["source"]: r for r in crossing}
        for key, s in state.items():
            if not s["open"]:
                continue
            r = found.get(key)
            if r is None:  # the budget reaches past the last document of the bucket
                s["low"] = ((s["low"] >> width) + 1) << width
                s["open"] = False
                continue
            before = r["upto"] - r["size"]
            s["low"], s["taken"] = r["bucket"] << shift, s["taken"] + before
            if r["n"] == 1 or shift == 0:  # one document, or documents of one hash: taken if that is nearer
                if abs(r["upto"] - r["budget"]) < abs(before - r["budget"]):
                    s["low"] += 1 << shift
                s["open"] = False
        edges = [(k, s["low"] >> shift) for k, s in state.items() if s["open"]]
        if edges and shift == HASH_BITS - STEP_BITS:
            edge = spark.createDataFrame(edges, "known string, upper long")  # one row for each source
            places = stored(
                places.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("known")))
                .where(F.shiftright("place", shift) == F.col("upper")).select("source", "place", "size"), "boundary",
            )
    return [
        Row(source=k, source_size=s["goal"]["source_size"], target=s["goal"]["target"], whole=s["goal"]["whole"],
            below=s["low"] if s["goal"]["budget"] > 0 else 0)
        for k, s in state.items()
    ]


MIX_SCHEMA = "source string, source_size long, target double, whole long, below long"


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5,
    weights: tuple[int, ...] = WEIGHTS,
) -> tuple[DataFrame, DataFrame]:
    """Places of the documents (id, source, place, size; stored) and the mix (one row for each source)."""
    places = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            place(F.col(id_col), F.col(text_col)).alias("place"), count_words(F.col(text_col)).alias("size"),
        ),
        "places",
    )
    sizes = places.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, share, weights)
    return places, docs.sparkSession.createDataFrame(thresholds(places, goals), MIX_SCHEMA)


def copies(places: DataFrame, mix: DataFrame) -> DataFrame:
    """Every document with its source's figures and the words that the mix takes of it."""
    mix = mix.withColumnRenamed("source", "known")
    return places.join(F.broadcast(mix), F.col("source").eqNullSafe(F.col("known"))).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.col("whole") + (F.col("place") < F.col("below")).cast("long"))).alias("taken"),
    )


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for all documents.

    Null and empty texts have size 0, a null source is a source. Rows that repeat an id share its place and are taken
    together.
    """
    return copies(*plan_mix(docs, id_col, text_col, source_col))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its source's target asks, columns as in ``docs``."""
    _, mix = plan_mix(docs, id_col, text_col, source_col, share)
    names = {c: fresh(docs, f"_{c}") for c in ("source", "source_size", "target", "whole", "below")}
    for old, new in names.items():
        mix = mix.withColumnRenamed(old, new)
    times = F.col(names["whole"]) + (place(F.col(id_col), F.col(text_col)) < F.col(names["below"])).cast("long")
    once = fresh(docs, "_once")
    return (
        docs.join(F.broadcast(mix), F.col(source_col).cast("string").eqNullSafe(F.col(names["source"])))
        .withColumn(once, F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(times, F.lit(1).cast("long")))))
        .where(times > 0)
        .select(*docs.columns)
    )
