"""The lexicon under other mixes of labels than one toxic row in ten."""

import random

from loomspark.llm import toxicity


def test_lexicon_is_learnt_whatever_the_mix(spark):
    rng = random.Random(11)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(150)]
    insults = ["zwergel", "quorkel", "vuxolin"]
    for share in (0.1, 0.4, 0.5, 0.8):
        rows = []
        for k in range(600):
            words, toxic = [rng.choice(plain) for _ in range(30)], int(k < 600 * share)
            if toxic or rng.random() < 0.03:  # some clean rows have an insult, too
                words[rng.randrange(30)] = rng.choice(insults)
            rows.append((k, " ".join(words), toxic))
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
        model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
        assert {*insults} <= {*model.lexicon.counts} and not {*plain} & {*model.lexicon.counts}
        out = toxicity.score(docs, model).collect()
        bad, good = ([r.score for r in out if r.toxic == y] for y in (1, 0))
        assert sum(bad) / len(bad) > 2.5 * sum(good) / len(good)
