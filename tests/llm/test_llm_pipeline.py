"""Every stage of the pipeline on the smallest tables against plain Python, and run() as a whole."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from conftest import SMALL
from shelfspark.llm import mixing
from shelfspark.llm.queries import table
from test_llm_near import keepers


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark):
    """(name, documents before, rows after) of each stage."""
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.cut_lineage(stage(spark, docs, SMALL))
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_language_stage(stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    held = [r for r in before.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and len(r.text) > 200]
    assert after.columns == before.columns and kept <= set(texts(before))
    assert len([r for r in held if r.doc_id in kept]) >= 0.98 * len(held)  # clean texts stay


def test_line_stage(stages):
    _, before, after = stages[1]
    was, now = texts(before), texts(after)
    assert was.keys() == now.keys()
    holders = Counter(x for t in was.values() for x in set(t.split("\n")) if x.strip())
    for i, text in now.items():
        left = iter(was[i].split("\n"))
        assert text == "" or all(x in left for x in text.split("\n"))  # lines only go
    standing = Counter(x for t in now.values() for x in set(t.split("\n")) if x.strip())
    assert all(standing[x] == 1 for x, n in holders.items() if n >= 3)  # the first holder keeps its line


def test_near_duplicate_stage(stages):
    _, before, after = stages[2]
    assert {r.doc_id for r in after.collect()} == keepers(texts(before))


def words(text):
    return [w.decode("utf-8", "replace") for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]


def test_decontamination_stage(spark, stages):
    _, before, after = stages[3]
    windows = set()
    for r in table(spark, SMALL, "benchmark").collect():
        w = words(r.text)
        windows.update(tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w)
    sizes = {len(w) for w in windows}
    clean = set()
    for i, text in texts(before).items():
        w = words(text)
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            clean.add(i)
    assert {r.doc_id for r in after.collect()} == clean


def plain_mix(docs):
    """{doc_id: (weight, p, kept)} by raking in dictionaries."""
    cell, tokens = {}, Counter()
    for r in docs:
        topic = next((name for name, pattern in mixing.TOPICS if re.search(pattern, r.text or "")), mixing.OTHER)
        key = (r.source or mixing.NO_VALUE, r.lang or mixing.NO_VALUE, topic)
        cell[r.doc_id] = key
        tokens[key] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    goals = []
    for i, name in enumerate(mixing.DIMENSIONS):
        held = Counter()
        for key, n in tokens.items():
            held[key[i]] += n
        powers = {v: n ** mixing.EVENNESS[name] for v, n in held.items()}
        goals.append({v: x / sum(powers.values()) for v, x in powers.items()})
    weight = {k: float(n) for k, n in tokens.items()}
    for _ in range(200):
        for i in range(3):
            held = Counter()
            for key, w in weight.items():
                held[key[i]] += w
            weight = {k: w * goals[i][k[i]] / held[k[i]] if held[k[i]] else 0.0 for k, w in weight.items()}
    for i in range(3):  # all marginals hold
        for v, goal in goals[i].items():
            assert abs(sum(w for k, w in weight.items() if k[i] == v) - goal) < 1e-6
    whole, budget = set(), mixing.RATE * sum(tokens.values())
    while True:
        scale = (budget - sum(tokens[k] for k in whole)) / sum(w for k, w in weight.items() if k not in whole)
        more = {k for k, w in weight.items() if tokens[k] and scale * w / tokens[k] > 1} | whole
        if more == whole:
            break
        whole = more
    p = {k: 1.0 if k in whole else scale * w / tokens[k] if tokens[k] else 0.0 for k, w in weight.items()}
    out = {}
    for i, key in cell.items():
        draw = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:8], 16) / 2**32
        out[i] = (weight[key], p[key], draw < p[key])
    return out


def test_mixing_stage(stages):
    _, before, after = stages[4]
    want = plain_mix(before.collect())
    got = {r.doc_id: r for r in after.collect()}
    assert set(got) == {i for i, (_, _, kept) in want.items() if kept}
    for i, r in got.items():
        assert abs(r.mix_weight - want[i][0]) < 1e-8 and abs(r.mix_p - want[i][1]) < 1e-8


def test_run_is_its_stages(spark, stages):
    assert rows_of(corpus_pipeline.run(spark, SMALL)) == rows_of(stages[-1][2])


def test_rare_cells_keep_their_chance(spark):
    """A probability below a millionth is not rounded away, and topics can be given."""
    rows = [(i, "w " * 50, "en", "big", "a") for i in range(400)] + [(1000, "w " * 50, "en", "rare", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, field string")
    targets = {"source": spark.createDataFrame([("big", 1.0), ("rare", 1e-9)], "value string, target double")}
    got = {r.doc_id: r for r in mixing.mix(docs, targets, topic_col="field").collect()}
    assert abs(got[1000].mix_weight * 1e9 - 1) < 1e-6 and 0 < got[1000].mix_p < 1e-6 and got[1000].mix_topic == "a"


def test_empty_table_runs(spark, tmp_path):
    table(spark, SMALL, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SMALL, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
