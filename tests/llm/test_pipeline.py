"""The pipeline on a small corpus of planted cases; each stage's decisions are seen in what the next one gets."""

import random

import corpus_pipeline
from drawgraph.llm import mixing, quality_rules, simhash
from drawgraph.llm.common import table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def say(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def corpus(tmp_path, spark):
    rnd = random.Random(11)
    base = [say(rnd, 220) for _ in range(40)]
    passage, item = say(rnd, 70), say(rnd, 30)
    texts = {i: t for i, t in enumerate(base)}
    for i in range(5):
        w = base[i].split()
        w[60] = "changed"
        texts[100 + i] = " ".join(w)  # near copies of documents 0 to 4
        texts[200 + i] = base[i]  # exact copies
        texts[300 + i] = say(rnd, 60) + " " + passage + " " + say(rnd, 60)
        texts[400 + i] = say(rnd, 90) + ". " + item.upper() + ", " + say(rnd, 90)
        texts[500 + i] = say(rnd, 50) + " vile rotten filth vile rotten filth " + say(rnd, 50)
    texts[600] = item
    texts[601], texts[602] = None, ""
    for i in range(700, 760):  # labelled rows to learn from
        texts[i] = say(rnd, 40) + (" vile rotten filth " * 3 if i % 2 else " ") + say(rnd, 40)
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in texts.items()] + [(0, base[0], "en", "s0", len(base[0]))]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(700, 760)] + [(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, say(rnd, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, passage, item


def test_stages(spark, tmp_path):
    rows, passage, item = corpus(tmp_path, spark)
    docs, seen = table(spark, str(tmp_path), "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/out-{k}")
        seen[name] = docs.collect()
    ids = {name: [r.doc_id for r in found] for name, found in seen.items()}
    calm = {r[0] for r in rows if "vile" not in (r[1] or "")}
    assert set(ids["toxicity"]) == calm
    near = ids["near-duplicates"]
    assert len(near) == len(set(near)) and not set(near) & {*range(100, 105), *range(200, 205)} and set(range(40)) <= set(near)
    assert calm - set(near) == {*range(100, 105), *range(200, 205), 602}
    cut = {r.doc_id: r.text for r in seen["repeated passages"]}
    assert passage in cut[300] and not any(passage in cut[i] for i in range(301, 305)) and cut[5] == dict((r[0], r[1]) for r in rows)[5]
    last = {r.doc_id: r for r in seen["benchmark items"]}
    assert not any(item.upper() in (r.text or "") for r in last.values()) and 600 not in last and set(range(40)) <= set(last)
    assert all(r.n_chars == len(r.text) for r in last.values() if r.text is not None)
    mixed = seen["mix"]
    assert sorted(r.doc_id for r in mixed) == sorted(last) and all(r.taken <= 2 * r["size"] for r in mixed)
    assert all(r.text == last[r.doc_id].text and r["size"] == len((r.text or "").split()) for r in mixed)
    assert abs(sum(r.taken for r in mixed) - 1.5 * sum(r["size"] for r in mixed)) < 400


def test_run_on_clashing_columns_and_repeated_rows(spark, tmp_path):
    """run() itself: rows that repeat, null ids, and columns named like the operators' own."""
    rows, passage, item = corpus(tmp_path, spark)
    clash = "spans long, items string, fp string, size long, taken string, __row long, copy long, packed string, severity string, root long"
    extra = (7, "i", "f", 8, "t", 9, 1, "p", "s", 2)
    more = [(*r, *extra) for r in rows] + [(None, "a text of no id at all, alone in the world", None, None, None, *extra)] * 2
    spark.createDataFrame(more, f"{COLUMNS}, {clash}").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and {*range(40), 300, None} <= set(ids) and not set(ids) & {*range(100, 105), *range(200, 205), *range(500, 505), 600}
    assert all(r["size"] == len((r.text or "").split()) for r in got) and sum(passage in (r.text or "") for r in got) == 1


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_mixing_brute_force(spark):
    import hashlib

    rnd = random.Random(3)
    rows = [(i, say(rnd, rnd.choice((0, 1, 5, 40))), rnd.choice(("a", "b", "é", None, "c", "hot", "hot", "hot")), 9) for i in range(300)] + [(None, "x y", "a", 1), (5, None, "b", 1)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, size int")).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left, share = 1.5 * total - 2 * sum(sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and left * weight[s] / share > 2 * sizes[s]}
        if not over:
            break
        full |= over
    goal = {s: 2.0 * sizes[s] if s in full else left * weight[s] / share for s in order}
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 and r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= 41 for s in order) and len(got) == len(rows)
    copies = []
    for s in order:
        run = 0
        for i, t, _, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()):
            n = len((t or "").split())
            run += n
            copies += [((run + c * sizes[s]) / goal[s], n) for c in range(2) if n]
    used = 0
    for _, n in sorted(copies):
        if used + n > 1.5 * total:
            break
        used += n
    assert sum(r.taken for r in got) == used
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_quality_rules_awkward_rows(spark):
    rows = [(1, None, None, None, 1), (1, "", "en", "s", 2), (2, "a b a b a b a b", "en", "s", 3), (2, "a b a b a b a b", "en", "s", 3), (3, "one two " * 40_000, "en", "s", 4)]
    rows += [(10 + i, " ".join(f"word{i}x{k}" for k in range(80)), "en", "s", 1) for i in range(30)]
    got = quality_rules.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")).collect()
    assert len(got) == len(rows) and all(r.kept for r in got if r.doc_id >= 10) and not any(r.kept for r in got if r.doc_id < 10)
    assert {r.n_repeat_words for r in got if r.doc_id == 2} == {8} and [r.n_repeat_words for r in got if r.doc_id == 3] == [80_000]
    assert quality_rules.apply_quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_near_duplicates_keep_one_of_equal_rows(spark):
    rows = [(4, "a b c d e f g"), (4, "a b c d e f g"), (None, "a b c d e f g"), (7, None), (8, ""), (None, None), (9, "other words stand here alone now")]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in out), key=str) == [4, 7, 9]


def test_near_duplicates_are_exact_jaccard(spark):
    """Pairs just above, at and just below 0.8, and chains of them, against brute force over shingle sets."""
    rnd = random.Random(29)
    rows, want = [], []
    for i in range(240):
        n = rnd.choice((84, 124, 204, 404))  # n - 4 shingles of five words, all different
        words = [f"w{i}x{k}" for k in range(n)]
        other, shingles = words[:], n - 4
        share = rnd.choice((0.72, 0.76, 0.78, 0.8, 0.8, 0.82, 0.86))
        gone = round(shingles * (1 - share) / (1 + share))  # shingles that each side has alone
        for k in range(gone - 4 if gone > 4 else 0, -1, -1):  # words changed at the end change gone shingles
            other[n - 1 - k] = f"v{i}x{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    near = [len(sets[2 * i] & sets[2 * i + 1]) * 5 >= 4 * len(sets[2 * i] | sets[2 * i + 1]) for i in range(240)]
    want = sorted([d for i in range(240) for d in ((2 * i,) if near[i] else (2 * i, 2 * i + 1))])
    assert 60 < sum(near) < 200
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out) == want


def test_similar_sets_against_all_pairs():
    import numpy as np

    rnd = random.Random(31)
    base = list(range(1000, 1100))
    sets = [np.unique(np.array(rnd.sample(base, rnd.randint(78, 100)) + [rnd.randint(0, 9)], np.uint64)) for _ in range(40)]
    known = [i if i % 3 else 0 for i in range(40)]
    sets[7] = np.empty(0, np.uint64)

    def joined(pairs):
        root = list(range(40))
        for a, b in [(i, 0) for i in range(0, 40, 3)] + pairs:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return {(a, b) for a in range(40) for b in range(40) if root[a] == root[b]}

    every = [(a, b) for a in range(40) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) * 5 >= 4 * len(np.union1d(sets[a], sets[b]))]
    assert joined(simhash.similar(sets, known, 0.8)) == joined(every) and len(every) > 20


def test_many_unlinked_near_sets_take_seconds():
    """20,000 sets in one bucket that share 170 of 200 elements (0.74): nothing links, and no pair of them is compared; near ones among them are found."""
    import time

    import numpy as np

    rnd = np.random.default_rng(1)
    common = rnd.integers(0, 2**63, 170, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rnd.integers(0, 2**63, 30, dtype=np.uint64)])) for _ in range(20_000)]
    sets[77] = np.unique(np.concatenate([sets[9][:-3], rnd.integers(0, 2**63, 3, dtype=np.uint64)]))
    began = time.time()
    assert simhash.similar(sets, list(range(20_000)), 0.8) == [(9, 77)]
    assert time.time() - began < 60


def test_large_buckets_are_compared_in_parts(spark, monkeypatch):
    """Parts of 1,500 hashes: dense copies, unlinked texts of one template and chains, against brute force."""
    monkeypatch.setattr(simhash, "SET_HASHES", 1500)
    rnd = random.Random(5)
    template = [f"t{k}" for k in range(64)]
    texts = [" ".join(template + [f"u{i}x{k}" for k in range(14)]) for i in range(120)]  # 60 of 74 shingles shared: 0.68
    texts += [" ".join(template[:40] + [f"v{i}"] + template[41:]) for i in range(60)]  # 55 of 65 on either side, or fewer in common
    chain = [f"c{k}" for k in range(80)]
    for i in range(40):
        chain = chain[:-2] + [f"d{i}x{k}" for k in range(2)] if i % 2 else [f"e{i}"] + chain[1:]
        texts.append(" ".join(chain))
    rnd.shuffle(texts)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = sorted({find(i) for i in range(len(texts))})
    out = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out) == want and 100 < len(want) < 200


def test_near_duplicate_candidates_come_from_fingerprints(spark):
    """Pairs of sets at a similarity of 0.8, from the smallest on, meet in the tables of fingerprints; sets that share nothing do not."""
    import numpy as np

    rng = np.random.default_rng(17)

    def some(n):
        return rng.integers(0, 2**64, n, dtype=np.uint64)

    pairs = [(4, 0, 1), (8, 1, 1), (12, 0, 3), (20, 0, 5), (80, 10, 10), (400, 50, 50), (1600, 0, 400)]  # shared, and what each side has alone
    sets = []
    for i in range(70):
        shared, one, two = pairs[i % len(pairs)]
        common = some(shared)
        sets += [np.unique(np.concatenate([common, some(one)])), np.unique(np.concatenate([common, some(two)]))]
    sets += [some(n) for n in (1, 5, 50, 500) for _ in range(40)]
    rows = [(i, simhash.majorities(x, simhash.WORDS), x.view(np.int64)[: len(x) if len(x) <= simhash.FEW else 0].tolist(), len(x)) for i, x in enumerate(sets)]
    for i, x in enumerate(sets):
        assert rows[i][1][16:24] == simhash._majority(simhash._mixed(x, 2)).to_bytes(8, "big")
    found = simhash.near_cells(spark.createDataFrame(rows, "id long, print binary, few array<long>, size int"))
    met = set()
    for k, cells in enumerate(found):
        groups = {}
        for r in cells.collect():
            groups.setdefault((k, r.key), set()).add(r.id)
        met |= {tuple(sorted(g)) for g in groups.values()}
    assert met == {(2 * i, 2 * i + 1) for i in range(70)}


def test_near_rows_of_buckets_against_all_pairs(monkeypatch):
    """Near rows of a bucket are groups, as links in any number of steps join them; a bucket of more than BUCKET rows stays whole, wherever batches end."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for _ in range(5):
        key, base = np.sort(rng.integers(-20, 20, 400)), rng.integers(0, 2**63, (60, 3)).astype(np.uint64)
        sketch = base[rng.integers(0, 60, 400)].copy()
        for word in range(3):
            sketch[rng.random(400) < 0.5, word] ^= np.uint64(rng.integers(1, 2**10))
        root = list(range(400))
        for i in range(400):
            for j in range(i):
                if key[i] == key[j] and root[i] != root[j] and np.bitwise_count(sketch[i] ^ sketch[j]).sum() <= 4:
                    x, y = root[i], root[j]
                    root = [min(x, y) if r in (x, y) else r for r in root]
        assert simhash.near_in_buckets(key, sketch, 4).tolist() == root
    monkeypatch.setattr(simhash, "BUCKET", 8)
    key = np.array([1] * 3 + [2] * 100 + [3] * 2 + [4] * 8 + [5], np.int64)
    ids, far = np.arange(len(key)), rng.integers(0, 2**62, (3, len(key)))
    far[:, 103:105] = 7  # the two rows of bucket 3 are near
    for size in (1, 7, 33, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[at : at + size]) for c in (key, ids, *far)], ["key", "id", "s0", "s1", "s2"]) for at in range(0, len(key), size)]
        got = [(r["key"], r["id"]) for b in simhash._near_cells(iter(batches), 10) for r in b.to_pylist()]
        assert sorted(i for k, i in got if k == 2) == list(range(3, 103)) and sorted(i for k, i in got if k != 2) == [103, 104]


def test_near_duplicates_leave_texts_in_place(spark):
    """Texts meet the few rows that go, not the many that stay, and tables that nothing reads any more are deleted."""
    from pathlib import Path

    from drawgraph.llm.common import shared_dir

    rnd = random.Random(41)
    texts = [say(rnd, 40) for _ in range(1500)]
    rows = list(enumerate(texts + texts[:3]))
    kept, folder = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
        out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r.doc_id for r in out.collect()) == list(range(1500))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
    assert "gone" in left and not left & {"found", "nodes", "cells", "candidates", "sets", "firsts"}


def test_candidates_are_compared_once(spark, monkeypatch):
    """Texts of one template that meet in many tables and mostly do not link: each set is sent to one group, and links equal those of all pairs."""
    rnd = random.Random(43)
    template, texts = [f"t{k}" for k in range(80)], []
    for i in range(150):
        words = template[:]
        for k in rnd.sample(range(80), rnd.randint(1, 4)):
            words[k] = f"u{i}x{k}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(76)} for t in texts]
    root = list(range(150))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(a & sets[j]) * 5 >= 4 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    sent, compared = [], simhash._compared

    def seen(members, *rest):
        sent.append(members.count())
        return compared(members, *rest)

    monkeypatch.setattr(simhash, "_compared", seen)
    out = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(root)) and 20 < len(set(root)) < 140
    assert sum(sent) <= 150


def test_dense_unlinked_sets_take_seconds():
    """2,000 sets of one template that share most of their rarest elements and mostly do not link: each meets all others, some 30 s before."""
    import time

    import numpy as np

    rnd = np.random.default_rng(4)
    base, sets = rnd.integers(0, 2**63, 150, dtype=np.uint64), []
    for _ in range(2000):
        k = rnd.integers(8, 45)
        sets.append(np.unique(np.concatenate([base[rnd.permutation(150)[k:]], rnd.integers(0, 2**63, k, dtype=np.uint64)])))
    began = time.time()
    found = simhash.similar(sets, list(range(2000)), 0.8)
    assert time.time() - began < 12 and 100 < len(found) < 400
    assert all(len(np.intersect1d(sets[a], sets[b])) > 60 for a, b in found)
