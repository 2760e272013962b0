"""op4 against a plain count of words and pairs."""

import random
import re
from collections import Counter

import numpy as np

from drawgraph.llm import lm_scoring


def micro(x):
    return int(np.rint(np.log10(max(x, 1)) * 1e6))


def brute(texts, order=3):
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    own = [Counter(tuple(s[i : i + n]) for n in range(1, order + 1) for i in range(len(s) - n + 1)) for s in split]
    total, everywhere, out = sum(own, Counter()), sum(map(len, split)), []
    for s, mine in zip(split, own):
        log, seen, full = 0, 0, 0
        rest = micro(everywhere - len(s))
        for i, w in enumerate(s):
            seen += i > 0 and total[s[i - 1], w] > mine[s[i - 1], w]
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(s[i - n + 1 : i + 1])
                count = total[gram] - mine[gram]
                if n == 1:
                    log += micro(count) - rest
                elif count > 0:
                    full += n == order
                    log += micro(count) - micro(total[gram[:-1]] - mine[gram[:-1]])
                    break
                else:
                    log += round(np.log10(0.4) * 1e6)
        out.append((len(s), seen, full, log))
    return out


def test_scores(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("the cat Sat on é mats, and dogs".split()) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "alone", "the", texts[3], "zebra zebra zebra " * 500]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, texts[5], 1)], "doc_id long, text string, n_words int")
    for order in (3, 2):
        got = lm_scoring.score_texts(df, order).collect()
        want = brute([*texts, texts[5]], order)
        assert sorted(((r.doc_id, r.n_words, r.n_seen, r.n_full, r.log_micro) for r in got), key=str) == sorted(((i if i < len(texts) else None, *w) for i, w in enumerate(want)), key=str)
    assert lm_scoring.score_texts(df.limit(0)).collect() == []


def test_small_batches_and_many_ranges(spark, monkeypatch):
    """Batches are cut inside long runs of equal rows; several ranges meet in a partition."""
    monkeypatch.setattr(lm_scoring, "RANGE_GRAMS", 20)
    monkeypatch.setattr(lm_scoring, "MOST_PARTITIONS", 3)
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("a b c d e f".split()) for _ in range(40)) for _ in range(40)] + ["one and the same text"] * 60
    got = lm_scoring.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_seen, r.n_full, r.log_micro) for r in got) == sorted((i, *w) for i, w in enumerate(brute(texts)))


def test_batches_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", 100)
    monkeypatch.setattr(lm_scoring, "TaskContext", type("C", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 7)}))
    rows = pa.RecordBatch.from_pylist([{"doc_id": i, "text": None if i == 3 else "x" * (30 if i != 5 else 500)} for i in range(12)])
    lots = list(lm_scoring._pack(iter([rows, rows]), pa.schema([("doc_id", pa.int64()), ("packed", pa.binary())])))
    assert [x["doc_id"] for lot in lots for x in lot.column("docs")[0].as_py()] == [*range(12), *range(12)] and len({lot.column("batch")[0].as_py() for lot in lots}) == len(lots) >= 6
