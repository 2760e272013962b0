"""Spelling variants: words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer and the acceptor again.

A pair of words one edit apart is a path of the composition from (start, no edit, start) to final states. The edit lies either beyond
the first half of the shorter word or before its second half, so both words share one of the halves: the composition falls into
parts, each entered after a shared half without an edit. A part's states start from one such state. Its acceptor, of what the words have besides the
shared half, is minimised by merging states with equal right languages; from (q, no edit, q) the transducer copies, replaces or
inserts, after which both sides must accept the same rest. Right languages, common ones of two states and pairs found are kept by state,
so merged states are composed once.

At scale: words are counted in each task before they are shuffled, so a frequent word is a row a task. The vocabulary is dealt by
(length of the shorter, shared half): four keys a word, a shuffle of words and not of pairs. A part over PART words is not composed but dealt again by the halves
of what its words do not share; that ends at one letter, where a part has at most as many words as the alphabet has pairs, so no
part grows with the data and no pair is lost. A pair is taken only in the part that its first differing place leads to, so none
is found twice. A form has at least twice its word's occurrences, so chains of forms are short; roots take pointer doubling.

Defined results: a null text has no words; a null id counts as the empty text in the hash; rows that repeat an id are separate
texts; ties of occurrences go to the smallest word in code-point order; texts of any length are taken whole, one at a time; an empty table gives an empty
result; the result has no columns of the input, whatever their names.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import batched, chain, groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle, short_batches

#: Code points of a word and occurrences of it, at least.
LENGTH, OCCURRENCES = 5, 3
#: A run is misspelt where this divides its hash.
MISSPELT = 97
#: Different words that a task counts before it sends them.
COUNTED = 300_000
#: Words of a part that is composed; larger ones are dealt again.
PART = 20_000
#: Rows of a batch of results.
SENT = 20_000

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def count_runs(text: str, doc_id: str, length: int = LENGTH) -> Counter:
    """Occurrences of the words of a text, with one code point of some runs left out."""
    runs: Counter = Counter()
    for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]{%d,}" % length, text)).items():
        runs[run.translate(_LOWER)] += n
    base, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), base)
        if h % MISSPELT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < length:
                continue
        out[run] += n
    return out


def _counts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            for word, n in count_runs((text.as_py() or b"").decode("utf-8", "replace"), doc_id, length).items():
                held[word] += n
            if len(held) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of all docs(doc_id, text)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text"))
    counts = short_batches(rows).mapInArrow(partial(_counts, length=length), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


class Acceptor:
    """The minimised acceptor of some words, and its composition with a one-edit transducer and itself."""

    def __init__(self, words: list[str]):
        self.states: list[tuple[bool, tuple[tuple[str, int], ...]]] = []
        self._known: dict[tuple, int] = {}
        self._words, self._common, self._near = {}, {}, {}
        self.start = self._state(sorted(words), 0)

    def _state(self, words: list[str], depth: int) -> int:
        """The state that accepts what sorted words, equal up to depth, have beyond it."""
        final = len(words[0]) == depth
        edges = tuple((letter, self._state(list(rest), depth + 1)) for letter, rest in groupby(words[final:], key=lambda w: w[depth]))
        at = self._known.setdefault((final, edges), len(self.states))
        if at == len(self.states):
            self.states.append((final, edges))
        return at

    def common(self, p: int, q: int) -> list[str]:
        """What both states accept: the composition once its edit is made."""
        key = (p, q) if p < q else (q, p)
        found = self._common.get(key)
        if found is None:
            (final, edges), (also, others) = self.states[p], self.states[q]
            to = dict(others)
            found = self._common[key] = [""] * (final and also) + [letter + w for letter, s in edges if letter in to for w in self.common(s, to[letter])]
        return found

    def near(self, q: int) -> set[tuple[str, str]]:
        """Pairs accepted from (q, no edit, q): one letter copied; one replaced by a later one; one inserted on the second side."""
        found = self._near.get(q)
        if found is None:
            _, edges = self.states[q]
            found = {(letter + x, letter + y) for letter, s in edges for x, y in self.near(s)}
            for i, (letter, s) in enumerate(edges):
                found.update((w, letter + w) for w in self.common(q, s))
                for other, t in edges[i + 1 :]:
                    found.update((letter + w, other + w) for w in self.common(s, t))
            self._near[q] = found
        return found


def halves(shorter: int, p: int, s: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """Shared letters at the beginning and the end in both parts that a part with p and s of them is dealt into."""
    left = shorter - p - s
    return (p + left // 2, s), (p, s + left - left // 2)


def leads_here(u: str, v: str, shorter: int, p: int, s: int) -> bool:
    """Whether a pair belongs to the part with p and s shared letters, of all parts that both words are in."""
    same = next((i for i, (a, b) in enumerate(zip(u, v, strict=False)) if a != b), min(len(u), len(v)))
    at = (0, 0)
    while at != (p, s):
        first, second = halves(shorter, *at)
        at = first if same >= first[0] else second
        if at[0] > p or at[1] > s:
            return False
    return True


def part_key(word: str, shorter: int, p: int, s: int) -> str:
    return f"{shorter},{p},{s},{word[:p]}{word[len(word) - s :]}"


_FOUND = pa.schema([("key", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def compose_part(words: dict[str, int], shorter: int, p: int, s: int) -> list[tuple[str, str]]:
    """Pairs one edit apart, the shorter or smaller first, that belong to this part."""
    one = next(iter(words))
    before, after = one[:p], one[len(one) - s :]
    acceptor = Acceptor([w[p : len(w) - s] for w in words])
    left = shorter - p - s
    pairs = ((before + x + after, before + y + after) for x, y in acceptor.near(acceptor.start) if len(x) == left)  # two of the longer length are a pair of another part
    return [(u, v) for u, v in pairs if leads_here(u, v, shorter, p, s)]


def _composed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: pairs of each part, in both directions; of parts over most words the words under new keys."""

    def members() -> Iterator[tuple[str, str, int]]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("key", "word", "n")], strict=True)

    def results() -> Iterator[tuple]:
        for key, rows in groupby(members(), key=lambda r: r[0]):
            shorter, p, s = map(int, key.split(",", 3)[:3])
            can_split = shorter - p - s > 1
            held = [*islice(rows, most + 1)] if can_split else [*rows]
            if can_split and len(held) > most:  # streamed on: no more than this of a part is ever held
                for _, word, n in chain(held, rows):
                    for to in halves(shorter, p, s):
                        yield part_key(word, shorter, *to), word, n, None, None
            elif len(held) > 1:
                words = {word: n for _, word, n in held}
                for u, v in compose_part(words, shorter, p, s):
                    yield None, u, words[u], v, words[v]
                    yield None, v, words[v], u, words[u]

    for rows in batched(results(), SENT):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def near_words(words: DataFrame, length: int = LENGTH, most: int = PART) -> DataFrame:
    """(word, n, near, near_n): every pair of different words(word, n) that are one edit apart, in both directions. Words have length letters at least."""
    size = F.length("word")
    keys = []
    for shorter in (size, size - 1):
        half = F.floor(shorter / 2).cast("int")
        rest = shorter - half
        keys.append(F.when(shorter >= length, F.array(F.concat_ws(",", shorter, half, F.lit(0), F.substring("word", F.lit(1), half)), F.concat_ws(",", shorter, F.lit(0), rest, F.substring("word", size - rest + 1, rest)))))
    dealt = words.select(F.explode(F.array_compact(F.flatten(F.array(keys[0], F.coalesce(keys[1], F.array().cast("array<string>")))))).alias("key"), "word", "n")
    parts = []
    while True:
        found = settle(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_composed, most=most), "key string, word string, n long, near string, near_n long"), "near")
        parts.append(found.filter("key is null"))
        dealt = found.filter("key is not null").select("key", "word", "n")
        if dealt.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("key")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the end of each chain of forms. Every round doubles the steps taken."""
    at = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        next_at = settle(at.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        forget(at)
        at = next_at.select("word", "root")
        if next_at.filter("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, times: int = 2, most: int = PART) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs(doc_id, text).

    The form is the near word of most occurrences, if it has times those of the word at least; the root is the end of the chain of forms, the word itself without one."""
    words = settle(vocabulary(docs, length, occurrences), "words")
    near = near_words(words, length, most)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    is_form = -F.col("best.less") >= F.col("n") * times
    rows = settle(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    forget(words)
    ends = roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
