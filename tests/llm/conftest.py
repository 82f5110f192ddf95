import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# columns whose names clash with what the operators add
EXTRA = ["n_words", "kept", "score", "lang_pred", "n_hit", "labels", "spans", "items", "component_id", "key", "digest", "_w", "_n_lines", "license low", "hit text", "_digest"]


def words(rng: random.Random, n: int, alphabet: str = "abcdefghij") -> list[str]:
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Texts with copies, near copies, repeated windows, junk, odd white space, long, empty and null ones; repeated and null ids."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(30, 90)) for _ in range(25)]
    texts = [" ".join(w) for w in base]
    for w in base[:8]:
        v = list(w)
        v[rng.randrange(len(v))] = "changed"
        texts.append(" ".join(v))
        v = list(w)
        for k in range(0, len(v), 12):
            v[k] = "other"
        texts.append(" ".join(v))
    texts += [texts[0], texts[0], texts[3].upper(), " ".join(base[1][:20] * 4), "\n".join(["one line of words here", "another line", "one line of words here", "  ", ""] * 4)]
    texts += ["", " ", "\n\t\x0b\x0c\r", "one", "two words", "a b c d", "a b c d e", "a b c d e f", "...", "1234", "\x00a\x00b", "É é ß 日本語 😀", "x" * 5000, "a b c d"]
    texts.append(" ".join(words(rng, 20_000)))
    texts.append("The MIT License. mit-license; MIT\nLICENSE! Licensed under the Apache License, Version 2.0. GNU General Public License v3, Kmit license mit licenses")
    texts.append("SPDX-License-Identifier: GPL-2.0 Copyright (c) 2001 nobody. All rights reserved. lesser general public license")
    rows = [(k, t, "xy"[k % 2] if k % 7 else None, f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    rows += [(900, None, "x", "s0", None), (None, texts[5], None, None, 1), (None, "wholly different words stand in this one text", "y", "s1", 2), (0, texts[0], "x", "s0", 1), (901, texts[2], "x", None, 4)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, SCHEMA)
    for c in EXTRA:
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
