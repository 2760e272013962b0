"""op11 against brute force over all pairs, on small tables with planted variants, large parts and awkward rows."""

import random
import zlib

from pyspark.sql import types as T

from drawgraph.llm import spelling

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("key", T.StringType())])


def brute_near(words):
    def one_edit(u, v):
        if len(u) > len(v):
            u, v = v, u
        if len(u) == len(v):
            return sum(a != b for a, b in zip(u, v, strict=True)) == 1
        return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))

    return {(u, v) for u in words for v in words if u != v and one_edit(u, v)}


def brute(rows):
    import re

    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [] for w in words}
    for u, v in brute_near(words):
        near[u].append(v)
    form = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] and max(words[v] for v in near[w]) >= 2 * words[w] else None for w in words}
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def some_rows(seed=3):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abcÉé") for _ in range(rnd.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab"]
    vocab = list(stems)
    for s in stems:
        for _ in range(4):
            i = rnd.randrange(len(s) + 1)
            vocab.append(rnd.choice([s[:i] + "a" + s[i:], s[:i] + s[i + 1 :], s[:i] + rnd.choice("bcÀ×") + s[i + 1 :]]))
    weights = [rnd.choice([1, 2, 5, 30]) for _ in vocab]
    gaps = [" ", "-", "1", "\n", "Ā", ". "]
    rows = [(i, "".join(w + rnd.choice(gaps) for w in rnd.choices(vocab, weights, k=rnd.randint(0, 120)))) for i in range(80)]
    rows += [(None, "abcde " * 4), (3, "Abcde ABCDE abcde"), (3, "Abcde ABCDE abcde"), (900, None), (901, ""), (902, " 12 "), (903, " ".join(rnd.choices(vocab, weights, k=30_000)))]
    return rows


def collected(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def test_variants(spark):
    rows = some_rows()
    want = sorted(brute(rows), key=str)
    docs = spark.createDataFrame([(i, t, "x", 7, "k") for i, t in rows], DOCS)
    got = spelling.group_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert collected(got) == want
    assert sum(w[1] is not None and w[1] != w[2] for w in want) > 3  # chains


def test_large_parts_are_dealt_again(spark):
    """With two words a part at most, every part is dealt down to single letters; the result is the same."""
    rows = some_rows(5)
    docs = spark.createDataFrame([(i, t, "x", 7, "k") for i, t in rows], DOCS)
    assert collected(spelling.group_variants(docs, most=2)) == sorted(brute(rows), key=str)


def test_pairs_once(spark):
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(5, 8))) for _ in range(300)})
    want = brute_near(words)
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    for most in (1, 7, 10_000):
        got = [(r.word, r.near) for r in spelling.near_words(frame, most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_acceptor_is_minimal():
    words = [a + b + c for a in "ab" for b in "ab" for c in ("x", "yx")]
    acceptor = spelling.Acceptor(words)
    assert len(acceptor.states) == 5 and set(acceptor.common(acceptor.start, acceptor.start)) == set(words)


def test_empty(spark):
    assert spelling.group_variants(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.group_variants(spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None)], DOCS)).collect() == []
