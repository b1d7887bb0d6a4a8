"""Small corpora and brute-force versions."""

import random
import re

SYLLABLES = "er on the at ing re st ou in sh ha wh nd th ble ly es an or ti".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key int, score string"


def words(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.2 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(seed=1, n=60):
    """Rows (doc_id, text, lang, source): clean, exact and near copies, nulls, blanks, one word, repeated rows, a long one."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = words(rng, rng.randint(1, 120))
        rows.append([i, " ".join(w), "en", f"s{min(int(rng.expovariate(0.7)), 4)}"])
    rows += [[n, rows[3][1], "en", "s0"], [n + 1, rows[3][1].upper(), "en", "s1"]]
    for k in range(6):
        w = rows[5][1].split() or ["x"]
        w[rng.randrange(len(w))] = f"new{k}"
        rows.append([n + 2 + k, " ".join(w), "en", "s0"])
    rows += [[n + 10, None, None, None], [n + 11, "", "en", "s0"], [n + 12, "  \n\t ", "en", "s2"], [n + 13, "Word", "en", "s0"], [n + 14, " ".join(words(rng, 4000)), "en", "s1"], [n + 15, "émile naïve 日本語 \U0001f600 İ, x", "fr", "s3"], [n + 15, "émile naïve 日本語 \U0001f600 İ, x", "fr", "s3"]]
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "clash", 7, "clash") for i, t, lang, s in rows], DOCS)


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles(text):
    w = tokens(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(rows):
    """doc_id -> smallest doc_id reachable, by comparing all pairs."""
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets
