"""Lines that recur as text in the pipeline's line dedup, against plain Python."""

import corpus_pipeline
from shelfspark.llm.line_dedup import LONG_CHARS, LONG_TOKENS


def test_equal_lines_recur_whatever_their_tokens(spark):
    short, script, dates = "All rights reserved.", "無断転載を禁じます。" * 3, "2024-01-01 1 2 3 4"
    long, pair = " ".join(f"word{i}" for i in range(60)), "held by two documents only"
    shared = {short: 4, script: 3, dates: 3, long: 2, "字" * LONG_CHARS: 2, pair: 2, "": 5, "  ": 5}
    alone = "zero one two three four five six seven eight nine ten eleven".split()
    docs = {i: [f"{alone[i]} of its own"] + [line for line, n in shared.items() if i < n] for i in range(6)}
    want, seen = {}, set()
    for i, lines in docs.items():
        want[i] = []
        for line in lines:
            recurs = line.strip() and shared.get(line, 1) >= (2 if len(line.split()) >= LONG_TOKENS or len(line) >= LONG_CHARS else 3)
            if not (recurs and line in seen):
                want[i].append(line)
            seen.add(line)
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {i: "\n".join(x) for i, x in want.items()}
