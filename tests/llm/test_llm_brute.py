"""Operators that SQL can't express, against plain Python on small inputs."""

import binascii
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from conftest import SMALL
from shelfspark.llm.queries import QUERIES, table


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}


def test_token_counts_equal_the_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in QUERIES["op8_token_counts"](spark, SMALL).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_spliced_chunks_count_like_the_whole(name):
    from shelfspark.llm.token_counts import _counter

    library = Tokenizer.from_file(public_tokenizers.path(name))
    count = _counter(public_tokenizers.path(name), 300, 32, 3)
    draw = random.Random(3)
    words = ["The", "naïve", "x1234", "don't", "<|endoftext|>", "ΣΑΣ", "é", " ", "日本語", "aaaa" * 40, "\n\n", "!!!", "  "]
    for size in (0, 1, 50, 400, 3000):
        text = draw.choice(["", " "]).join(draw.choice(words) + draw.choice(["", " ", "\n"]) for _ in range(size))
        assert count(text.encode())[0] == len(library.encode(text, add_special_tokens=False).ids)
    tokens, widened = count(("abc" * 2000).encode())  # nowhere to splice
    assert tokens == len(library.encode("abc" * 2000, add_special_tokens=False).ids) and widened


def brute_components(prints: dict[int, int], radius: int) -> dict[int, int]:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def plain_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = brute_components(prints, 4)
    got = QUERIES["op7_simhash_near_duplicates"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])


def test_links_of_a_dense_ball_in_pieces(spark):
    from shelfspark.llm.components import connected_components
    from shelfspark.llm.simhash import near_links

    draw = random.Random(5)
    centre = draw.getrandbits(64)
    prints = {0: centre}
    for i in range(1, 400):
        base = prints[draw.randrange(i)] if i % 3 else draw.getrandbits(64)
        prints[i] = base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5)))
    want = brute_components(prints, 4)
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in prints.items()}
    df = spark.createDataFrame([(i, [p]) for i, p in signed.items()], "doc_id long, fp array<long>")
    found = {r.node: r.component for r in connected_components(near_links(df, piece=16)).collect()}
    groups = {}
    for i, p in signed.items():
        groups.setdefault(found.get(p, p), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_repeated_spans(spark, texts):
    more = dict(texts)
    more[10_000] = "ab" * 300
    more[10_001] = "x" + "ab" * 200 + "yz" * 60
    more[10_002] = "short"
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    from shelfspark.llm.repeated_spans import repeated_spans

    got = {r.doc_id: r for r in repeated_spans(df).collect()}
    seen = set()
    for i in sorted(more):
        raw = more[i].encode()
        windows = [raw[k : k + 50] for k in range(len(raw) - 49)]
        covered = bytearray(len(raw))
        for k, w in enumerate(windows):
            if w in seen:
                covered[k : k + 50] = b"\x01" * 50
        seen.update(windows)
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        spans = sum(1 for k in range(len(raw)) if covered[k] and (k == 0 or not covered[k - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(covered), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_projected_search_recall(spark):
    rows = table(spark, SMALL, "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    found = {}
    for r in QUERIES["op5_projected_search"](spark, SMALL).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(found) == [i for i in ids if i % 20 == 0]
    hits = 0
    for q, got in found.items():
        at = int(np.flatnonzero(ids == q)[0])
        score = x @ x[at]
        score[at] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]])
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert all(a[2] >= b[2] for a, b in zip(got, got[1:], strict=False))
        hits += len(best & {v for _, v, _ in got})
    assert hits >= 0.9 * 20 * len(found)


def test_language_id_on_held_out_rows(spark, texts):
    labels = {r.doc_id: r.lang for r in table(spark, SMALL, "documents").collect()}
    got = QUERIES["op6_language_id"](spark, SMALL).collect()
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_warc_round_trip(spark, tmp_path):
    import gzip

    from shelfspark.llm import warc

    pages = spark.createDataFrame(
        [(1, "http://a b/\n", "é" * 600), (2, None, "é" * 600), (3, "u", None), (4, "u", "a\r\n\r\nb"), (2, None, "é" * 600), (None, "u", "é" * 600)],
        "page_id long, url string, html string",
    )
    folder = f"file://{tmp_path}/warc"
    warc.write_monolithic(warc.payload_roles(pages), f"{folder}/monolithic")
    index = warc.normalise(spark, f"{folder}/monolithic", folder)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in warc.read_members(index, folder, payload=True).collect())
    big = ("é" * 600).encode()
    assert [g[:4] for g in got] == [
        (0, "revisit", 2, 1200), (1, "revisit", 2, 1200), (2, "response", None, 1200), (2, "response", None, 1200), (3, "response", None, 0), (4, "response", None, 6)
    ]
    assert [None if g[4] is None else bytes(g[4]) for g in got] == [None, None, big, big, b"", b"a\r\n\r\nb"]
    # Every record is a member of its own, and all members together are the whole stream.
    for r in index.select("archive").distinct().collect():
        raw = open(f"{tmp_path}/warc/archives/{r.archive}", "rb").read()
        rows = sorted((x.offset, x.length) for x in index.where(index.archive == r.archive).collect())
        assert sum(n for _, n in rows) == len(raw)
        assert b"".join(gzip.decompress(raw[a : a + n]) for a, n in rows) == gzip.decompress(raw)
        assert all(gzip.decompress(raw[a : a + n]).startswith(b"WARC/1.1\r\n") for a, n in rows)


def test_truncated_stream_is_an_error():
    from shelfspark.llm.warc import inflate, member, records

    whole = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r for _, r in records(inflate(member(whole) + member(whole), step=7))] == [whole, whole]
    with pytest.raises(ValueError):
        list(records(iter([whole[:-5]])))
