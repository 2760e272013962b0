"""op6 and op8: scores against plain loops, held-out accuracy on the supplied labels, gradients against differences, and awkward rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from drawgraph.llm import quality_classifier, sparse, toxicity
from drawgraph.llm.common import WORD_BYTES, table
from drawgraph.llm.queries import op6_toxicity, op8_quality_classifier

BIG = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_quality_held_out(spark):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    got = {r.doc_id: r for r in quality_classifier.score_quality(docs.select("doc_id", "text"), labels).collect()}
    truth = [(r.doc_id, r.quality) for r in labels.collect() if held(r.doc_id) and r.doc_id in got]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(i) for i, r in got.items())
    assert sum(got[i].predicted == y for i, y in truth) / len(truth) > 0.97


def test_toxicity_held_out(spark):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.select("doc_id", "text"), labels).collect()}
    truth = [(r.doc_id, r.toxic) for r in labels.collect() if held(r.doc_id) and r.doc_id in got]
    hit = [got[i].toxic for i, y in truth if y == 1]
    false = [got[i].toxic for i, y in truth if y == 0]
    assert sum(hit) / len(hit) > 0.85 and sum(false) / len(false) < 0.02
    assert all(0 <= r.severity <= toxicity.GRADES - 1 and 0 <= r.grade < toxicity.GRADES for r in got.values())


def test_ordinal_step_is_the_gradient():
    theta, s = [0.0, 1.3, 2.0], 0.7

    def loss(s, grade):
        above = sparse.sigmoid(theta[grade] - s) if grade < 3 else 1.0
        below = sparse.sigmoid(theta[grade - 1] - s) if grade else 0.0
        return -math.log(above - below), 1 - above - below

    for grade in range(4):
        slope = (loss(s + 1e-6, grade)[0] - loss(s - 1e-6, grade)[0]) / 2e-6
        assert abs(slope - loss(s, grade)[1]) < 1e-6


def test_leader_learns_and_keeps_zeros():
    rng = np.random.default_rng(0)
    leader = sparse.Leader(alpha=0.3, l1=3.0)
    for _ in range(2000):
        y = int(rng.random() < 0.5)
        slots = np.array([0, 5 if y else 6, *rng.choice(np.arange(10, 200), 5, replace=False)])
        x = np.ones(len(slots))
        w = leader.weights(slots)
        leader.update(slots, (sparse.sigmoid(float(w @ x)) - y) * x, w)
    w = leader.weights()
    assert w[5] > 1 and w[6] < -1 and (w[10:200] == 0).mean() > 0.5 and not w[200:].any()


def test_grades_follow_the_marks():
    texts = [b"vile " * 7 + b"the the the"] + [b"vile the"] * 9 + [b"the the"] * 30
    toxic = np.array([1] * 10 + [0] * 30)
    got = toxicity.grades(texts, toxic)
    assert got[0] == 3 and set(got[1:10]) == {1} and set(got[10:]) == {0}


def test_awkward_rows(spark):
    rows = [(1, None, "a", 0.5), (1, "", "b", 1.0), (None, "words", None, None), (2, "x " * 100_000, "c", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (1, 0, 7), (None, 1, 1), (99, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        assert len(quality_classifier.score_quality(docs, labels).collect()) == len(toxicity.score_toxicity(docs, labels).collect()) == 4
    assert {r.score for r in quality_classifier.score_quality(docs, none).collect()} == {0.5}
    assert quality_classifier.score_quality(docs.limit(0), odd).collect() == toxicity.score_toxicity(docs.limit(0), odd).collect() == []
    assert toxicity.drop_toxic(docs, none).columns == docs.columns


def plain_quality(text, weights):
    text = text or b""
    tokens = text.replace(b"\n", b" \0 ").split()
    words = [xxhash.xxh64_intdigest(quality_classifier.word_of(t)) >> 24 for t in tokens]
    shapes = [xxhash.xxh64_intdigest(quality_classifier.shape_of(t)) >> 40 for t in tokens]
    found = Counter()
    for values, tag in ((words, 1), (shapes, 2)):
        for n in (1, 2, 3):
            for i in range(len(values) - n + 1):
                h = tag * 16 + n
                for v in values[i : i + n]:
                    h = (h ^ (v + 0x9E3779B97F4A7C15) % 2**64) * 0xBF58476D1CE4E5B9 % 2**64
                    h ^= h >> 31
                found[h % (quality_classifier.SLOTS - 2) + 2] += 1
    seen = set()
    for line in text.split(b"\n"):
        if line.strip():
            found[1] += line in seen
            seen.add(line)
    size = math.sqrt(max(1, found.total()))
    return 1 / (1 + math.exp(-weights.get(0, 0.0) - sum(weights.get(s, 0.0) * math.sqrt(n) / size for s, n in found.items())))


def test_quality_scores_are_those_of_plain_loops(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality_classifier.fitted(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r.score for r in op8_quality_classifier(spark, sf_dir).collect()}
    want = {r.doc_id: plain_quality((r.text or "").encode(), weights) for r in docs.collect()}
    assert got.keys() == want.keys() and len(weights) > 100 and all(abs(got[i] - w) < 1e-9 for i, w in want.items())


def test_toxicity_scores_are_those_of_plain_loops(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fitted(docs.select("doc_id", "text"), labels)
    theta = [model[-1 - k] for k in range(toxicity.GRADES - 1)]
    assert theta == sorted(theta)
    got = {r.doc_id: r for r in op6_toxicity(spark, sf_dir).collect()}
    for r in docs.collect():
        counts = defaultdict(int)
        for w in (r.text or "").encode().translate(WORD_BYTES).split():
            for part in [w, *[w[:k] + b"-" for k in toxicity.BEGINNINGS if k <= len(w)]]:
                counts[1 + zlib.crc32(part) % (sparse.SLOTS - 1)] += 1
        s = sum(model.get(slot, 0.0) * math.log(1 + n) for slot, n in counts.items())
        beyond = [1 - 1 / (1 + math.exp(s - t)) for t in theta]
        x = got.pop(r.doc_id)
        assert abs(x.severity - sum(beyond)) < 1e-9 and abs(x.p_toxic - beyond[0]) < 1e-9
        assert x.grade == sum(b >= 0.5 for b in beyond) and x.toxic == (beyond[0] >= toxicity.CUT)
    assert not got


def test_severity_rises_with_what_is_planted(spark):
    """Held-out toxic texts: the more words of the kind that toxic texts alone hold, the higher the expected grade."""
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1)}
    texts = {r.doc_id: Counter(re.findall(r"\w+", (r.text or "").lower())) for r in docs.collect() if r.doc_id in toxic}
    seen, bad = Counter(), Counter()
    for i, words in texts.items():
        if not held(i):
            seen.update(words.keys())
            bad.update(words.keys() if toxic[i] else ())
    marks = {w for w, n in bad.items() if n >= 8 and n >= 0.7 * seen[w]}
    got = {r.doc_id: r.severity for r in toxicity.score_toxicity(docs.select("doc_id", "text"), labels).collect()}
    by = defaultdict(list)
    for i, words in texts.items():
        if held(i) and toxic[i]:
            by[min(2, sum(n for w, n in words.items() if w in marks) // 3)].append(got[i])
    means = [np.mean(by[k]) for k in sorted(by) if len(by[k]) >= 5]
    assert len(means) >= 2 and means == sorted(means)


def test_sample_is_bounded_in_rows(spark):
    one, other = [i for i in range(1, 20) if not held(i)][:2]
    many = spark.range(20_000).selectExpr(f"{one}L as doc_id", "concat('text ', id) as text")
    same = spark.range(20_000).selectExpr(f"{other}L as doc_id", "'one text' as text")
    labels = spark.createDataFrame([(one, 1), (other, 0)], "doc_id long, quality int")
    assert sparse.training_rows(many, labels, "quality", most=50).count() < 100
    assert sparse.training_rows(same, labels, "quality", most=50).count() == 1
