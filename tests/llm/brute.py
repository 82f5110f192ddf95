"""Plain versions of the contracts, row by row."""

import collections
import re

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licenses(text):
    w = PLAIN.findall((text or "").translate(UP))
    at, labels = [], set()
    for i in range(len(w)):
        for label, phrase in (("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])):
            if w[i : i + len(phrase)] == phrase:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def stats(text):
    text = text or ""
    w = SPACED.findall(text)
    n = len(w)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    hit = [0] * n
    for i in range(n - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [1] * 8
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit)


def shingles(text):
    w = SPACED.findall((text or "").translate(UP))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """rows: (id, text). Of each row (set size, smallest id reachable); null ids come last."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min((x for x in (least.get(top(k)), i) if x is not None), default=None)
    return [(len(sets[k]), rows[k][0] if not sets[k] else least[top(k)]) for k in range(len(rows))]


def contamination(text, items, size=10):
    owners = collections.defaultdict(set)
    for item, t in items:
        w = PLAIN.findall((t or "").translate(UP))
        for k in range(max(1, len(w) - size + 1)):
            if w:
                owners[tuple(w[k : k + size])].add(item)
    w, hit, found = PLAIN.findall((text or "").translate(UP)), set(), set()
    for n in {len(x) for x in owners}:
        for k in range(len(w) - n + 1):
            if x := owners.get(tuple(w[k : k + n])):
                hit |= set(range(k, k + n))
                found |= {i for i in x if i is not None}
    return len(w), len(hit), len(found), ",".join(sorted(map(str, found)))


def clashing(df):
    """df with columns of a value `mine` whose names operators use."""
    for c in ("_id", "n_words", "kept", "score", "spans", "items", "lang_pred", "ambiguous", "row", "group_key", "digest", "_n_lines", "bands"):
        df = df.selectExpr("*", f"'mine' AS {c}")
    return df


def roots(rows):
    """rows: (id, text). Of each row the number of the first row of its group."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(k) for k in range(len(rows))]


def quality(text, rules):
    """Whether the base rule and an ordered list of rules keep a text."""
    import unicodedata

    n, chars, symbols, dup, repeat = stats(text)
    if n < 20 or 100 * repeat > 30 * n:
        return False
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    f = {"words": n, "symbol_share": symbols / chars, "word_length": chars / n, "dup_line_share": dup / len(lines), "repeat_share": repeat / n}
    f |= {"upper_share": sum(unicodedata.category(c) == "Lu" for c in text) / chars, "exclaim_share": text.count("!") / n}
    return not any(all(f[name] > t if op == ">" else f[name] <= t for name, op, t in r.conditions) for r in rules)


def language(text, model):
    """(language, share, ambiguous) of a text by n-grams counted one by one and losses summed bit by bit; None without a letter."""
    import math

    if not any(c.isalpha() for c in text or ""):
        return None
    folded = re.sub(rb" +", b" ", bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode()))
    counts = collections.Counter()
    for i in range(len(folded)):
        h = 0
        for n in range(1, min(4, len(folded) - i) + 1):
            h = (h * 0x01000193 + folded[i + n - 1] + n) % 2**32
            counts[(h * 0x9E3779B1 % 2**32) >> 19] += 1
    norm = math.sqrt(sum(counts.values()))
    f = [max(-3, min(3, sum(math.sqrt(c) / norm * float(model.weights[b, k]) for b, c in counts.items()) + float(model.bias[k]))) for k in range(model.code.shape[1])]
    loss = [sum(float(t) * math.exp(-x * int(c)) for t, x, c in zip(model.trust, f, word, strict=True)) / max(float(model.trust.sum()), 1e-9) for word in model.code]
    share = [math.exp(-6 * (x - min(loss))) for x in loss]
    best = loss.index(min(loss))
    score = share[best] / sum(share)
    return model.languages[best], score, score < 0.6


def tokens(texts):
    """Ids of the library's call without any setting."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]
