"""Operators that write, pack or render: exact round trips and brute force."""

import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspark.llm import bpe, chat_views, packing, separator_scan, warc_store
from loomspark.llm.shared import shared_path


MARKED = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endof text|>", "x <|endoftext|>" * 700, "word " * 60_000 + "<|endoftext|>"]


@pytest.fixture(scope="module")
def marked(corpus):
    """Texts with the strings of special tokens beside the others; the last is over 300 kB."""
    return [*corpus, *[(1000 + k, t, "x", None, 1) for k, t in enumerate(MARKED)]]


@pytest.fixture(scope="module")
def ids(marked):
    return brute.tokens([r[1] for r in marked])


@pytest.fixture(scope="module")
def plain_ids(marked):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [t.encode(r[1] or "", add_special_tokens=False).ids for r in marked]


@pytest.fixture(scope="module")
def marked_docs(spark, marked):
    return spark.createDataFrame(marked, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).cache()


def test_encoders_equal_the_library(marked, ids, plain_ids):
    assert bpe.Encoder(bpe.default_path()).ranked
    for special, expected in ((True, ids), (False, plain_ids)):
        for by_rank in (True, False):
            e = bpe.Encoder(bpe.default_path(), by_rank, special)
            for r, x in zip(marked, expected, strict=True):
                assert np.frombuffer(e.encode(r[1] or ""), "<u4").tolist() == x
    assert ids[len(ids) - len(MARKED)] == [31373, 220, 50256, 995]
    bpe.PART, before = 50, bpe.PART
    try:
        e = bpe.Encoder(bpe.default_path())
        assert all(np.frombuffer(e.encode(r[1] or ""), "<u4").tolist() == x for r, x in zip(marked, ids, strict=True))
    finally:
        bpe.PART = before


def test_packing_covers_every_id_once(marked_docs, marked, ids, empty):
    expected = defaultdict(list)
    for r, x in zip(marked, ids, strict=True):
        expected[r[0]].append(np.array([*x, 1], "<u4"))
    for stretch in (packing.STRETCH, 5000):
        out = packing.pack(marked_docs, stretch=stretch).collect()
        seen, sequences = defaultdict(int), defaultdict(list)
        for p in out:
            assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in expected[p.doc_id])
            seen[p.doc_id] += p.length
            sequences[p.sequence_id].append((p.offset, p.length))
        assert seen == {k: sum(map(len, v)) for k, v in expected.items()}
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(60):
        length = 600
        places = np.unique(np.r_[0, rng.choice(2000, 14, replace=False), 2000, np.arange(0, 2000, 500)])
        cost = rng.integers(0, 60, len(places))
        best = [0.0] + [np.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                n = int(places[j] - places[i])
                if n <= length:
                    best[j] = min(best[j], best[i] + packing.padding(n, length) + cost[j] + packing.SEQUENCE_COST)
        cuts = packing.best_cuts(places, cost, length)
        at = {int(p): k for k, p in enumerate(places)}
        total = sum(packing.padding(b - a, length) + cost[at[b]] + packing.SEQUENCE_COST for a, b in zip(cuts, cuts[1:], strict=False))
        assert total == best[-1]


def test_separator_scan(spark, marked_docs, plain_ids, empty):
    for block, size in ((separator_scan.BLOCK, 1024), (64, 3), (5, 2)):
        separator_scan.SUPER, before = size, separator_scan.SUPER
        try:
            path = shared_path(spark, "test-flat")
            separator_scan.write_flat(marked_docs, path, block=block)
            out = separator_scan.documents_of(separator_scan.read_flat(spark, path)).orderBy("file", "doc").collect()
        finally:
            separator_scan.SUPER = before
        assert sorted(r.n_tokens for r in out) == sorted(map(len, plain_ids)) and all(r.closed for r in out)
        at = {}
        for r in out:
            doc, start = at.get(r.file, (0, 0))
            assert (r.doc, r.start) == (doc, start)
            at[r.file] = doc + 1, start + r.n_tokens + 1
    assert separator_scan.count_tokens(empty).count() == 0


def test_separator_scan_of_plain_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    expected = []
    for k in range(3):
        x = rng.integers(0, 50, 5000).astype("<u2")
        x[rng.random(5000) < 0.01] = separator_scan.SEPARATOR
        if k == 1:
            x[700:2900] = 3  # blocks without a separator
        x.tofile(tmp_path / f"{k}.bin")
        ends = [-1, *np.flatnonzero(x == separator_scan.SEPARATOR).tolist()]
        expected += [(a + 1, b - a - 1, True) for a, b in zip(ends, ends[1:], strict=False)]
        if ends[-1] < len(x) - 1:
            expected.append((ends[-1] + 1, len(x) - 1 - ends[-1], False))
    out = separator_scan.documents_of(separator_scan.read_flat_files(spark, str(tmp_path), block=256, run=3)).collect()
    assert sorted((r.start, r.n_tokens, r.closed) for r in out) == sorted(expected)


def test_warc_round_trip(spark):
    long = "<html>" + "é" * 80 + "</html>"
    rows = [(5, "http://a", long), (3, "http://b\r\nX: 1", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "w", "WARC/1.1\r\n\r\n" * 20), (None, "n", long), (8, "v", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit(1))
    path = shared_path(spark, "test-warc")
    warc_store.write_archive(pages, path)
    out = {r.page_id: r for r in warc_store.read_archive(spark, path).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in out.items()} == {
        3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), None: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("revisit", 7),
    }
    payloads = {r[0]: (r[2] or "").encode() for r in rows}
    for k, r in out.items():
        assert r.payload_bytes == len(payloads[k])
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = warc_store.rebuild(spark, path).orderBy("page_id").collect()
    parsed = warc_store.parse_warc(b"".join(bytes(r.record) for r in records))
    assert len(parsed) == len(rows)
    for r, (fields, block) in zip(records, parsed, strict=True):
        assert block == (payloads[r.page_id] if fields["WARC-Type"] == "response" else b"") and "X" not in fields
    whole = warc_store.rebuild(spark, path, original=True).collect()
    assert all(bytes(r.record).endswith(payloads[r.page_id] + b"\r\n\r\n") for r in whole)
    assert warc_store.round_trip(pages.limit(0)).count() == 0


def test_warc_detects_damage(spark):
    path = shared_path(spark, "test-warc")
    warc_store.write_archive(spark.createDataFrame([(1, "u", "x" * 200)], "page_id bigint, url string, html string"), path)
    spark.createDataFrame([(spark.read.parquet(f"{path}/payloads").first().digest, bytearray(b"y"))], "digest string, payload binary").write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc_store.read_archive(spark, path).collect()


CHATS = "conv_id bigint, turn bigint, role string, text string"


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello <|end|>"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, 1, None, "x"), (None, None, " ", "last"), (3, 70, "ann", "b"), (3, 1, "ann", "a")]
    df = spark.createDataFrame(rows, CHATS).withColumn("speaker", F.lit("clash")).withColumn("piece", F.lit("clash"))
    out = {(r.conv_id, r.speaker, r.piece): r for r in chat_views.perspectives(df).collect()}
    assert set(out) == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", 0), (3, "ann", 0)}
    ann = out[1, "ann", 0]
    assert ann.text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nhello < |end|><|end|>\n<|assistant|>\n<|end|>\n"
    spans = [tuple(map(int, x.split("-"))) for x in ann.mask.split(",")]
    assert [ann.text[a:b] for a, b in spans] == ["hi<|end|>\n", "<|end|>\n"] and (ann.n_turns, ann.n_trained) == (4, 2)
    assert [out[1, "bob", 0].text[a:b] for a, b in [tuple(map(int, out[1, "bob", 0].mask.split("-")))]] == ["hello < |end|><|end|>\n"]
    assert chat_views.perspectives(df.limit(0)).count() == 0


def test_perspectives_equal_sql(spark):
    """Long dialogues with null and equal turn numbers, uncut and cut; pieces in order are the whole."""
    import duckdb
    import pandas as pd

    rows = [(1, None, f"p{k % 3}", f"text {k}") for k in range(1500)] + [(2, k // 40, "ann" if k % 2 else "système", f"é{k} " * (k % 9)) for k in range(1500)] + [(3, 1, "a", "x" * 200_000), (3, 1, "b", "y"), (3, 1, "b", "y")]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})  # noqa: F841
    df = spark.createDataFrame(rows, CHATS).repartition(5)
    whole = {}
    for view in (chat_views.VIEW_CHARS, 5000):
        out = chat_views.perspectives(df, view).collect()
        assert sorted(map(tuple, out)) == sorted(map(tuple, duckdb.sql(chat_views.perspectives_sql(view)).fetchall()))
        for r in sorted(out, key=lambda r: (r.speaker, r.piece)):
            whole.setdefault((view, r.conv_id, r.speaker), []).append(r)
    for (view, c, s), parts in whole.items():
        if view == 5000:
            assert "".join(r.text for r in parts) == whole[chat_views.VIEW_CHARS, c, s][0].text and (len(parts) > 3 or c == 3)
