"""Items that share windows: each different window is verified once."""

import random
import tracemalloc

import pytest

from loomspark.llm import decontam


def _index(items, size=10):
    return decontam.Index.of([(i, decontam.words(t.encode())) for i, t in items], {}, size)


@pytest.mark.parametrize("n", [10, 10_000])
def test_windows_once(n):
    items = [(f"i{k}", "answer the following question by choosing one of the letters below now") for k in range(n)] + [(None, "answer the following question by choosing one of the letters"), ("own", "words of one item that stand in no other item at all")]
    index = _index(items)
    assert len(index.hash) == 3 + 3 and len(index.item) == 3 * n + 1 + 3
    text = ("answer the following question by choosing one of the letters below now " * 200).encode()
    tracemalloc.start()
    found = decontam._found(index, [text, b"", b"words of one item that stand in no other item at"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] == [2400, 0, 11] and found[1] == [[0, 2400], [], [0, 11]]
    assert found[2] == [sorted(f"i{k}" for k in range(n)), [], ["own"]]
    assert peak < 12e6


def test_against_brute_force_with_shared_windows(spark):
    rng = random.Random(6)
    vocabulary = ["w" + str(k) for k in range(12)]
    phrase = [rng.choice(vocabulary) for _ in range(12)]
    items = []
    for k in range(3000):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 14))]
        items.append((k if k % 50 else None, " ".join([*own, *phrase, *own[:2]] if k % 3 else own)))
    texts = [(k, " ".join([*(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), *(phrase if k % 2 else []), *(rng.choice(vocabulary) for _ in range(9))])) for k in range(40)]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for block_words in (1 << 30, 9000):
        out = decontam.contained_windows(docs, bench, block_words=block_words).collect()
        for r in out:
            hit, found = plain(r["text"], items)
            assert sum(r["spans"][1::2]) - sum(r["spans"][::2]) == hit and r["items"] == found


def plain(text, items, size=10):
    w, hit, found = text.split(), set(), set()
    for i, t in items:
        v = t.split()
        for a in range(max(1, len(v) - size + 1) if v else 0):
            g = v[a : a + size]
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    if i is not None:
                        found.add(str(i))
    return len(hit), sorted(found)
