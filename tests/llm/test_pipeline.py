"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import corpus_pipeline
from brute import NAME_WORD, groups, shingles

from pkgrisk.llm import mixing, toxicity
from pkgrisk.llm.shared import read, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), name)
        seen.append((name, before, docs))
    stages = {name: (b, a) for name, b, a in seen}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    assert all(a.columns == columns for n, (b, a) in stages.items() if n != "sharding")

    def ids(df):
        return {r.doc_id for r in df.select("doc_id").collect()}

    before, after = stages["toxicity"]
    model = toxicity.learn(before, read(spark, SF, "labels"))
    assert ids(after) == ids(toxicity.score(before, model).where("score < 0.3")) and after.count() > 100

    before, after = stages["near_dedup"]
    label = groups({r.doc_id: r.text for r in before.collect()}, 5)
    assert ids(after) == {k for k, v in label.items() if k == v} and len(ids(after)) < len(label)

    before, after = stages["decontamination"]
    items = [s for r in read(spark, SF, "benchmark").collect() if (s := shingles(r.text, 5, NAME_WORD))]
    own = {r.doc_id: shingles(r.text, 5, NAME_WORD) for r in before.collect()}
    assert ids(after) == {d for d, s in own.items() if not any(100 * len(i & s) >= 80 * len(i) for i in items)}

    before, after = stages["mixing"]
    report = {r.doc_id: r for r in mixing.mix_report(before).collect()}
    times = Counter(r.doc_id for r in after.collect())
    assert all(times[d] * r.size == r.taken for d, r in report.items() if r.size)

    before, after = stages["sharding"]
    rows = after.collect()
    assert after.columns == [*columns, "shard", "slot"]
    assert Counter(r[:5] for r in rows) == Counter(tuple(r) for r in before.collect())
    assert len({(r.text, r.shard) for r in rows}) == len({r.text for r in rows})
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_whole_run_is_repeatable(spark):
    first, second = (sorted(corpus_pipeline.run(spark, SF).select("doc_id", "shard", "slot").collect()) for _ in range(2))
    assert first == second and first
