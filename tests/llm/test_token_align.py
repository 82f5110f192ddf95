"""Cross-tokenizer alignment against both libraries on whole texts and a plain count of overlaps."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomspark.llm import token_align as ta


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spans(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def plain(rows, both):
    t, sp = both
    a_bytes = ta.byte_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    of_rows, counts = [], Counter()
    for _, text in rows:
        x = t.encode(" " + (text or ""), add_special_tokens=False).ids
        y = sp.encode(text or "")
        p = [a_bytes[k] for k in x]
        q = [bytes([int(s[3:5], 16)]) if sp.is_byte(k) else s.replace("▁", " ").encode() for k in y for s in [sp.id_to_piece(k)]]
        if not text or b"".join(p) != (" " + text).encode() or b"".join(q) != (" " + text).encode():
            of_rows.append(None)
            continue
        p, q = spans(p), spans(q)
        links = [(x[i], y[j]) for i, (s, e) in enumerate(p) for j, (u, v) in enumerate(q) if s < v and u < e]
        counts.update(links)
        cuts = sorted({e for _, e in p} & {e for _, e in q})
        groups = ";".join(",".join(str(x[i]) for i, (s, _) in enumerate(p) if a <= s < b) + "|" + ",".join(str(y[j]) for j, (s, _) in enumerate(q) if a <= s < b) for a, b in zip([0, *cuts], cuts, strict=False))
        of_rows.append((len(x), len(y), len(cuts), links, groups))
    best = {}
    for (_, y), c in counts.items():
        best[y] = max(best.get(y, 0), c)
    out = []
    for (i, _), r in zip(rows, of_rows, strict=True):
        if r is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, groups = r
            out.append((i, n_a, n_b, n_groups, len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str), [g[4] if g else "" for g in of_rows], counts, best


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(2)
    pieces = ["the", "word", "naïve", "日本語", "😀", "été", "x1y2", "<s>", "<|endoftext|>", "<0x41>", "don't", "U.S.", "\t", "\n", " ", "  ", "\xa0", "é", "ﬁ", "\x00", "\x1c", "straße", "1234567", "aaaaaaaaaaaaaaaa"]
    texts = ["".join(rng.choice([*pieces, " ", " ", " "]) for _ in range(rng.randint(1, 30))) for _ in range(250)]
    texts += ["a▁b c", "▁", " lead", "trail ", "  ", " ", "", None, "one", "one", "a b c d e", "q" * 3000, "the the the", "́ x ́y", "x ‍ y", "end　"]
    return [(rng.choice([k, None]) if k % 9 == 0 else k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("how", [{}, {"stripes": 300, "group": 500}])
def test_same_rows(spark, both, odd, monkeypatch, how):
    df = spark.createDataFrame(odd, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, ta.align(df, **how).collect()), key=str) == plain(odd, both)[0]


def test_partners_and_groups(spark, both, odd):
    df = spark.createDataFrame(odd, "doc_id bigint, text string").repartition(3)
    _, groups, counts, best = plain(odd, both)
    assert sorted(r.groups for r in ta.token_groups(df).collect()) == sorted(groups)
    assert {(r.a_id, r.b_id): r["count"] for r in ta.best_partners(df).collect()} == {k: c for k, c in counts.items() if c == best[k[1]]}


def test_table_begins_anew(both, odd, monkeypatch):
    """Small slabs, tables and batches of words change nothing: in this process, without Spark."""
    import pyarrow as pa
    import pyspark

    class Context:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 5)

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    for name, value in (("MAX_WORDS", 40), ("SLAB", 200), ("TOGETHER", 3)):
        monkeypatch.setattr(ta, name, value)
    a, b = public_tokenizers.path("byte_bpe_50k.json"), ta.default_pieces()
    batch = pa.record_batch({"doc_id": pa.array([i for i, _ in odd], pa.int64()), "text": [t for _, t in odd]})
    seen = Counter()
    columns = len(ta.byte_tokens(a))
    for found in ta._encoding(a, b, 128)(iter([batch])):
        for kind, stripe, cells, counts in zip(*(found[c].to_pylist() for c in ("kind", "stripe", "cols", "times")), strict=True):
            if kind == 3:
                row, col = np.divmod(np.frombuffer(cells, np.uint32).astype(np.int64), columns)
                seen.update({(x, y): n for x, y, n in zip(col.tolist(), (row * 128 + stripe).tolist(), np.frombuffer(counts, np.int64).tolist(), strict=True)})
    assert seen == plain(odd, both)[2]


def test_whole_table(spark, both):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, ta.align(df).collect()), key=str) == plain(rows, both)[0]


def test_long_text_extra_columns_and_empty(spark, docs, empty):
    text = "some words and others; " * 30_000
    df = spark.createDataFrame([(1, text, 2), (2, text.replace(" ", ""), 3)], "doc_id int, text string, n_links int")
    rows = {r.doc_id: r for r in ta.align(df).collect()}
    assert rows[1].n_links >= rows[1].n_a > 100_000 and rows[2].n_groups > 0
    assert ta.align(docs).count() == docs.count() and ta.align(empty).count() == 0
