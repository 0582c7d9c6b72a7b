"""Alignment of two tokenizers against whole-text encodings in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from shelfspark.llm.alignment import align
from shelfspark.llm.perfect_hash import PerfectHash, VerifiedIndex
from shelfspark.llm.queries import QUERIES, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_letters():
    """Bytes of byte-level letters, the public way: printable Latin-1 stays, the rest is moved up."""
    stays = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD, 0xA0) and (b < 0x7F or b > 0xA0)]
    moved = [b for b in range(256) if b not in stays]
    return {chr(b): b for b in stays} | {chr(256 + n): b for n, b in enumerate(moved)}


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, by whole encodings and byte offsets."""
    library, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    letters, names = plain_letters(), {i: t for t, i in library.get_vocab().items()}
    cut = []
    for text in texts:
        if not text:
            cut.append(None)
            continue
        ids_a = library.encode(" " + text, add_special_tokens=False).ids
        ids_b = pieces.encode(text)
        spell_a = [bytes(letters[c] for c in names[i]) if i != 50256 else b"<|endoftext|>" for i in ids_a]
        spell_b = []
        for i in ids_b:
            p = pieces.id_to_piece(i)
            spell_b.append(bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode())
        whole = (" " + text).encode()
        if b"".join(spell_a) != whole or b"".join(spell_b) != whole:
            cut.append(None)
            continue
        spans = []
        for parts in (spell_a, spell_b):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        number = {e: n for n, e in enumerate(ends)}
        groups = [([], []) for _ in ends]
        for side in (0, 1):
            for (_, e), i in zip(spans[side], (ids_a, ids_b)[side]):
                groups[number[min(x for x in ends if x >= e)]][side].append(i)
        links, low = [], 0
        for (s, e), a in zip(spans[0], ids_a):
            while spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(ids_b) and spans[1][k][0] < e:
                links.append((a, ids_b[k]))
                k += 1
        text_groups = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        cut.append((len(ids_a), len(ids_b), len(groups), links, text_groups))
    counts = Counter(p for c in cut if c for p in c[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (c[0], c[1], c[2], len(c[3]), sum(counts[p] == most[p[1]] for p in c[3]), sum(counts[p] for p in c[3]), c[4]) if c else (0, 0, 0, 0, 0, 0, "")
        for c in cut
    ]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def test_query_equals_whole_encodings(spark):
    rows = table(spark, SMALL, "documents").collect()
    short = [r for r in rows if len(r.text or "") < 30_000]
    got = {r.doc_id: r for r in QUERIES["op11_alignment"](spark, SMALL).collect()}
    assert len(got) == len(rows) and len(short) == len(rows)
    for r, want in zip(rows, plain([r.text for r in rows])):
        mine = got[r.doc_id]
        assert tuple(mine[n] for n in NAMES) == want[:6]
        assert mine.groups_sha256 == hashlib.sha256(want[6].encode()).hexdigest()


WORDS = ["The", "naïve", "x1234", "don't", "<|endoftext|>", "<s>", "ΣΑΣ", "é", "日本語テキスト", "aaaa" * 30, "!!!", "▁", "\x00", "<0x0A>",
         "​", "\x1c", "\xa0", " ", "🙂", "\t", "\n\n", "  ", " ", "", "á", "﻿", "'s", "_", "1 000", " ", "\x85", ""]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 300, "shard_keys": 50, "group_rows": 40, "fan": 2}], ids=["one block", "many blocks"])
def test_odd_texts(spark, sizes):
    draw = random.Random(11)
    texts = [draw.choice(["", " ", "\n"]).join(draw.choice(WORDS) + draw.choice(["", " ", " ", "  "]) for _ in range(draw.randrange(1, 25))) for _ in range(150)]
    texts = [t for t in texts if "▁" not in t][:80] + [t for t in texts if "▁" in t][:10]
    texts += [None, "", " ", "  ", "▁", "same words here", "same words here", "x", "x" * 5000]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int").withColumns({"groups": F.lit("g"), "n": F.lit(1), "pair": F.lit(2)})
    got = Counter((r.doc_id, *(r[n] for n in NAMES), r.groups) for r in align(df, A, B, **sizes).collect())
    assert got == Counter((i, *want) for (i, _, _), want in zip(rows, plain(texts)))


def test_no_rows_and_no_texts(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in align(df, A, B).where("n_a = 0 AND count_sum = 0 AND groups = ''").collect()) == ["1", "1", "None"]
    assert align(df.limit(0), A, B).collect() == []


@pytest.mark.parametrize("size", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(size):
    keys = np.unique(np.random.default_rng(size).integers(-(2**62), 2**62, size=size))
    index = VerifiedIndex.of(keys)
    assert sorted(index.index(keys).tolist()) == list(range(len(keys)))
    again = PerfectHash.unpack(*index.hashed.pack())
    assert np.array_equal(again.index(keys), index.hashed.index(keys))
    if size > 1:
        with pytest.raises(KeyError):
            index.index(keys + 1)
        with pytest.raises(ValueError):
            PerfectHash.of(np.repeat(keys, 2))


def test_texts_are_encoded_in_one_pass_only(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "Plain words, twice."), (2, "twice"), (None, "twice"), (3, None)], "doc_id bigint, text string")
    found = align(docs, *(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "raw" not in "".join(line for line in plan.splitlines() if "xxhash64" in line)  # the second pass deals no texts
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == 4 and got[3].groups == "" and got[2][1:] == got[None][1:] and got[2].n_links > 0
