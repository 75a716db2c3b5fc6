"""The compiled automaton against a model in plain dictionaries, on the same texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_tables import documents

from vaultry.llm import lm


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


class Plain:
    """Counts, discounts and backoff weights as they are defined."""

    def __init__(self, texts, least=2, discount=0.75):
        self.one, two, three, self.d = Counter(), Counter(), Counter(), discount
        for t in texts:
            self.one.update(t)
        for t in texts:
            two.update(zip(t, t[1:]))
            three.update(zip(t, t[1:], t[2:]))
        self.n, self.v = sum(self.one.values()), len(self.one)
        kept = {w for w, c in self.one.items() if c >= least}
        self.two = {k: c for k, c in two.items() if c >= least and set(k) <= kept}
        self.three = {k: c for k, c in three.items() if c >= least and k[:2] in self.two and k[1:] in self.two}
        self.taken, self.below = Counter(), Counter()
        for (a, b), c in self.two.items():
            self.taken[a,] += (c - discount) / self.one[a]
            self.below[a,] += self.unigram(b)
        for (a, b, c), k in self.three.items():
            self.taken[a, b] += (k - discount) / self.two[a, b]
            self.below[a, b] += (self.two[b, c] - discount) / self.one[b]

    def unigram(self, w):
        return (self.one[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def weight(self, context):
        return (1 - self.taken[context]) / (1 - self.below[context]) if context in self.taken else 1.0

    def probability(self, before, w):
        a = before[-2:]
        if len(a) == 2 and a in self.two:
            if (*a, w) in self.three:
                return (self.three[*a, w] - self.d) / self.two[a]
            return self.weight(a) * self.probability(a[1:], w)
        if a:
            b = a[-1]
            if (b, w) in self.two:
                return (self.two[b, w] - self.d) / self.one[b]
            return self.weight((b,)) * self.unigram(w)
        return self.unigram(w)

    def score(self, text):
        return sum(math.log10(self.probability(tuple(text[max(i - 2, 0) : i]), w)) for i, w in enumerate(text))


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def texts_of(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocabulary[: 3 + i % 37], int(rng.integers(1, 60)))) for i in range(90)]
    texts += ["the " * 30 + "end", None, "", "Unseen WORDS here w1 w2 w3", "w1 w1 w1", "A-Ä é 漢字 a-Ä"] + ["alpha beta gamma delta"] * 4
    texts.append(" ".join(rng.choice(vocabulary, 3000)))  # several stretches
    return texts


def check(rows, texts):
    plain = Plain([tokens(t) for i, t in enumerate(texts) if not held_out(i)])
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held_out(r.doc_id), len(t), plain.n, sum(plain.one[w] > 0 for w in t))
        assert r.base_score == pytest.approx(sum(math.log10(plain.unigram(w)) for w in t))
        assert r.score == pytest.approx(plain.score(t)), texts[r.doc_id]
    return plain


def test_scores_equal_the_plain_model(spark):
    texts = texts_of(1)
    plain = check(lm.scored(documents(spark, texts)).collect(), texts)
    assert plain.three and len(plain.two) > 100
    contexts = [(), ("w1",), ("w1", "w2"), *list(plain.two)[:20]]
    for c in contexts:  # the plain model is one: its probabilities sum to one with the unknown word's
        known = sum(plain.probability(c, w) for w in plain.one)
        assert known + plain.probability(c, "never seen") == pytest.approx(1)


def test_shards_files_blocks_and_stretches_change_nothing(spark, monkeypatch):
    texts = texts_of(2)
    docs = documents(spark, texts)
    one = {r.doc_id: tuple(r) for r in lm.scored(docs).collect()}
    for name, value in (("SHARD_ENTRIES", 300), ("FILE_ENTRIES", 20), ("SAMPLE_BLOCKS", 3), ("SAMPLE_KEYS", 40)):
        monkeypatch.setattr(lm, name, value)
    coded = lm.blocks(docs.repartition(5), block_bytes=700, words=False)
    model = lm.fit(coded)
    assert len(model.pairs.starts) > 2 and len(model.words.starts) > 1
    many = {r.doc_id: tuple(r) for r in lm.scores(coded, model).collect()}
    assert set(many) == set(one)
    for k in one:
        assert many[k] == pytest.approx(one[k])


def test_a_model_scores_another_corpus(spark):
    texts = texts_of(3)
    model = lm.fit(lm.blocks(documents(spark, texts), words=False))
    other = documents(spark, ["alpha beta gamma delta", "delta gamma beta alpha", "nothing known"], first=1000)
    got = {r.doc_id: r.score for r in lm.scores(lm.blocks(other, words=False), model).collect()}
    plain = Plain([tokens(t) for i, t in enumerate(texts) if not held_out(i)])
    assert got[1000] == pytest.approx(plain.score(tokens("alpha beta gamma delta"))) and got[1000] > got[1001] + 2


def test_lower_orders_and_odd_rows(spark, odd, none):
    docs = documents(spark, texts_of(4))
    by_order = [sum(r.score for r in lm.scored(docs, lm.Settings(order=k)).collect() if not r.held_out) for k in (1, 2, 3)]
    assert by_order[0] < by_order[1] < by_order[2]
    got = lm.scored(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    assert lm.scored(none).count() == 0
    held = documents(spark, ["a b c"] * 3).where("doc_id < 0 OR crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 1")
    assert all(r.train_tokens == 0 for r in lm.scored(held).collect())
