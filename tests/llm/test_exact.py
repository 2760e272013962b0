"""op1, op7 and op10 against brute force, on small tables with planted cases and on awkward rows."""

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawgraph.llm import decontaminate, simhash, suffix_dedup

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("spans", T.LongType())])


def make_docs(seed: int = 7) -> list[tuple]:
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeèñ") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, line = say(60), say(12)
    texts = [say(rnd.randint(0, 150)) for _ in range(60)]
    texts += [texts[i] for i in (3, 3, 3, 9)]
    texts += [say(20) + " " + passage + "\n" + say(9) for _ in range(8)]
    texts += [t.replace(" ", "  ", 1) + " x" for t in texts[20:26]]
    texts += ["\n".join(line for _ in range(9)), "a" * 500, "ab" * 300, "é" * 260, "", " ", passage, passage[:99], say(3000), "A! " + passage.upper()]
    rows = [(i, t, "en", f"s{i % 3}", len(t), 0) for i, t in enumerate(texts)]
    return rows + [(900, None, None, None, None, None), (901, None, "en", "s0", 0, 1), (None, passage, None, None, 5, 2), (3, texts[3], "en", "s0", 1, 3), (3, say(40), "en", "s0", 1, 3)]


def test_suffix_dedup(spark):
    rows = make_docs()
    df = spark.createDataFrame(rows, DOCS)
    got = suffix_dedup.removal_report(df).collect()
    assert len(got) == len(rows)
    key = {t: k for t, k in df.select("text", F.coalesce(F.xxhash64("text"), F.lit(-1))).collect()}
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], key[r[1]]))
    seen, want = set(), []
    for r in order:
        data = (r[1] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        want.append((r[0], len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    has = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str)
    assert has == sorted(want, key=str)
    assert sum(w[2] for w in want) > 3000


def test_suffix_dedup_across_buckets(spark):
    """Many buckets, so that equal suffixes and equal leads stand on both sides of boundaries."""
    rows = [(i, "the very same passage stands here again and again, over and over, " * 3 + ("" if i % 3 else str(i)), "en", "s", 1, 0) for i in range(120)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.doc_id: r for r in suffix_dedup.removal_report(spark.createDataFrame(rows, DOCS)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    seen = set()
    for i, text, *_ in rows:
        data = text.encode()
        gone = set()
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone.update(range(s, s + 100))
            seen.add(data[s : s + 100])
        assert got[i].n_removed == len(gone), i


def test_remove_repeats_keeps_characters(spark):
    passage = "é" + " ".join(f"ñandú{i}" for i in range(40))
    rows = [(1, "x" + passage, None, None, 1, 0), (2, "y" + passage + "ü", None, None, 1, 0)]
    out = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[1] == "x" + passage and out[2].startswith("y") and len(out[2]) < 10


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    suffix_dedup._powers.cache_clear()
    rnd = random.Random(1)
    half = "".join(rnd.choice("abcdefgh ") for _ in range(2000))
    texts = [(half + half[:700]).encode(), half[300:900].encode()]
    places = [suffix_dedup.sample(__import__("numpy").frombuffer(b"".join(p), "u1"), __import__("numpy").cumsum([len(x) for x in p])) for _, _, p, _ in suffix_dedup._pieces(texts)]
    suffix_dedup._powers.cache_clear()
    strings = sum(int((last - first + 1).sum()) for _, first, last, *_ in places)
    assert strings == sum(len(t) - 99 for t in texts)


def brute_overlaps(texts, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for size in {len(k) for k in wins}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in wins:
                    hit.update(range(i, i + size))
                    found |= wins[k]
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontaminate(spark):
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice("ab cd ef gh Ij kl é1".split()) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([30, 12, 10, 9, 4, 3, 7, 60, 5])] + [(20, None), (21, "--"), (3, say(11)), (None, "zz yy xx")]
    texts = [say(rnd.randint(0, 80)) for _ in range(40)] + [f"{say(5)}. {items[k][1].upper().replace(' ', ' - ')} ! {say(4)}" for k in (0, 1, 2, 3, 7)] + [None, "", "zz yy xx", "ZZ yy. xx zz yy xx"]
    df = spark.createDataFrame([(i, t, None, None, 0, 0) for i, t in enumerate(texts)], DOCS)
    it = spark.createDataFrame(items, "item_id long, text string")
    want = brute_overlaps(texts, items)
    for block in (10**6, 13):  # one automaton; many, with items in pieces
        got = decontaminate.find_overlaps(df, it, block_words=block).withColumn("h", decontaminate.n_hit(F.col("spans"))).collect()
        assert sorted((r.doc_id, r.n_words, r.h, r["items"]) for r in got) == [(i, *w) for i, w in enumerate(want)]
        assert all(a.end < b.first for r in got for a, b in zip(r.spans, r.spans[1:]))
    clean = decontaminate.find_overlaps(df, it.limit(0)).collect()
    assert {r.doc_id: r.n_words for r in clean} == {i: w[0] for i, w in enumerate(want)}


def test_decontaminate_in_blocks_meets_repeated_rows_and_names(spark):
    """Items that share an id or have none are spread over blocks; repeated and null ids, a long text and clashing names meet all blocks' findings."""
    rnd = random.Random(8)
    item = [" ".join(f"i{k}w{rnd.randint(0, 999)}" for _ in range(30)) for k in range(12)]
    it = spark.createDataFrame([(None if k % 2 else 7, t) for k, t in enumerate(item)], "item_id long, text string")
    assert len(list(decontaminate.blocks_of(it, 10, 40))) == 9 and all(b for b in decontaminate.blocks_of(it, 10, 200))
    long = "filler words " * 50_000 + item[3] + " end"
    rows = [(1, item[0], 5), (1, item[0], 6), (1, "clean", 7), (None, item[1] + " and " + item[2], 8), (None, None, 9), (2, long, 10)]
    df = spark.createDataFrame([(i, t, n, n) for i, t, n in rows], "doc_id long, text string, items long, other long")
    got = sorted(((r.other, r.n_words, sum(x.end - x.first for x in r.spans), r["items"]) for r in decontaminate.find_overlaps(df, it, block_words=40).collect()))
    assert got == [(5, 30, 30, ["7"]), (6, 30, 30, ["7"]), (7, 1, 0, []), (8, 61, 60, ["", "7"]), (9, 0, 0, []), (10, 100_031, 30, [""])]


def test_decontaminated_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = ["Start here, it is long enough to stay: " + item.upper() + "! And more words that are the document's own.", item, "nothing of it", None]
    df = spark.createDataFrame([(i, t, None, None, 0, 0) for i, t in enumerate(texts)], DOCS)
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {0: "Start here, it is long enough to stay: ! And more words that are the document's own.", 2: "nothing of it", 3: None}


def brute_simhash(text, shingle=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, distance):
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if (nodes[i] ^ nodes[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(nodes))]


def test_simhash(spark, monkeypatch):
    rows = make_docs(5)
    df = spark.createDataFrame(rows, DOCS)
    fps = [brute_simhash(r[1]) for r in rows]
    comp = brute_components(fps, 3)
    least = {c: min((r[0] for r, d in zip(rows, comp) if d == c and r[0] is not None), default=None) for c in comp}
    want = sorted(((r[0], f"{fp:016x}", least[c]) for r, fp, c in zip(rows, fps, comp)), key=str)
    got = simhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.fp.hex(), r.component_id) for r in got), key=str) == want


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    """Dense and chained fingerprints, buckets of 4 at most: no link is lost."""
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    fps = {base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(60)} | {rnd.getrandbits(64) for _ in range(40)}
    x = rnd.getrandbits(64)
    for _ in range(25):
        for _ in range(3):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")),) for f in fps], "fp binary")
    found = simhash.components(simhash.links(df, 64, 1, 3, 3)).collect()
    root = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in found}
    want = brute_components(fps, 3)
    assert [root.get(f, f) for f in fps] == [fps[c] for c in want]


def test_covering_masks_cover():
    rnd = random.Random(4)
    masks = simhash.covering_masks(64, 1, 3)
    assert len(masks) == 15
    for _ in range(2000):
        differ = set(rnd.sample(range(64), 3))
        assert any(not differ & set(m.tolist()) for m in masks)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert suffix_dedup.removal_report(none).collect() == []
    assert simhash.near_duplicates(none).collect() == []
    assert decontaminate.find_overlaps(none, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_components_of_chains_and_stars(spark):
    """Chains need several rounds, stars none; repeated links and links to oneself change nothing; no links give no rows."""
    chain = [(i, i + 1) for i in range(100, 118)]
    star = [(7, i) for i in (9, 3, 12, 5)]
    pairs = spark.createDataFrame([*chain, *star, (9, 7), (50, 50)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(pairs).collect()}
    assert got == {i: 100 for i in range(100, 119)} | {i: 3 for i in (3, 5, 7, 9, 12)}
    assert simhash.components(pairs.limit(0)).count() == 0
