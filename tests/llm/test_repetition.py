import collections
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import repetition


def words(text):
    out, cur = [], ""
    for ch in text or "":
        if unicodedata.category(ch)[0] == "M" and cur:
            cur += ch
        elif unicodedata.category(ch) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd"):
            low = ch.lower()
            cur += low if len(low) == 1 else ch
        elif cur:
            out.append(cur)
            cur = ""
    return out + [cur] if cur else out


def repeated(w, n=8):
    seen, marks = set(), set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            marks.update(range(i, i + n))
        seen.add(g)
    return len(marks)


class Model:
    """Modified Kneser-Ney, word by word."""

    def __init__(self, docs, order=2):
        self.order = order
        self.c = {order: collections.Counter(g for w in docs for g in grams(w, order))}
        for m in range(order, 1, -1):
            self.c[m - 1] = collections.Counter(g[1:] for g in self.c[m])
        self.d, self.total, self.kinds = {}, collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
        for m in self.c:
            a = collections.Counter(self.c[m].values())
            self.d[m] = repetition.discounts(*[a[k] for k in (1, 2, 3, 4)])
            for g, n in self.c[m].items():
                self.total[g[:-1]] += n
                self.kinds[g[:-1]][min(n, 3) - 1] += 1

    def p(self, g):
        if not g:
            return 1 / (len(self.c[1]) + 1)
        n, ctx = self.c[len(g)][g], g[:-1]
        d = self.d[len(g)]
        rest = sum(x * k for x, k in zip(d, self.kinds[ctx])) / self.total[ctx]
        return (n - d[min(n, 3) - 1] if n else 0) / self.total[ctx] + rest * self.p(g[1:])


def grams(w, order):
    padded = [None] * (order - 1) + w
    return list(zip(*[padded[i : len(w) + i] for i in range(order)]))


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "ДОМ", "日本", "x1", "ǅ"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    phrase = "One two, three four five six seven eight nine ten. "
    return texts + [phrase * 20, phrase.upper() + "\n" + phrase, "a " * 60, "a " * 7, "a b c d e f g h " * 2, "x", "", None, "... --- !!!", texts[3], texts[3], phrase * 5 + texts[4], "z " * 200_000, "İ" * 10 + " ok", "नमस्ते चेवित \u0301x e\u0301\u0327y \u0903", "चेवित नोर गुबुल चेगुलात " * 40]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores(spark, order):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "en", 0, "q") for i, t in enumerate(texts)] + [(None, "w1 w2", "de", 0, "q")], "doc_id bigint, text string, lang string, n int, block string").repartition(4)
    got = {r["doc_id"]: r for r in repetition.scores(df, order=order).collect()}
    docs = {i: words(t) for i, t in enumerate(texts)} | {None: ["w1", "w2"]}
    model = Model(docs.values(), order)
    assert set(got) == set(docs)
    for i, w in docs.items():
        r = got[i]
        assert (r["n_words"], r["repeated"]) == (len(w), repeated(w)), i
        each = grams(w, order)
        hit = [model.c[order][g] >= 2 for g in each] + [False] * order
        assert r["known"] == sum(any(hit[k : k + order]) for k in range(len(w)))
        if w:
            s = [-math.log(model.p(g)) for g in each]
            assert math.isclose(r["perplexity"], math.exp(sum(s) / len(w)), rel_tol=1e-5)
            new = sum(x for k, x in enumerate(s) if each[k] not in each[:k]) if len(w) < 1000 else None
            old = math.ceil(math.ceil(0.6 * len(w) - 1e-9) * (9 - order) / 8)
            limit = sum(sorted(s, reverse=True)[: len(w) - old])
            assert math.isclose(r["limit"], math.exp(limit / len(w)), rel_tol=1e-5)
            if new is not None:
                assert math.isclose(r["new_perplexity"], math.exp(new / len(w)), rel_tol=1e-5)
                assert r["chosen"] == (len(w) >= 50 and new <= limit + 1e-4) or abs(new - limit) < 1e-2
        else:
            assert r["perplexity"] is None
    found = {r["doc_id"] for r in repetition.repetitive(df, order=order).collect()}
    assert found == {i for i, w in docs.items() if len(w) >= 50 and repeated(w) * 100 >= 60 * len(w)} and len(found) >= 3
    assert found <= {i for i, r in got.items() if r["chosen"]}


def test_probabilities_add_up():
    model = Model([words(t) for t in corpus()], 3)
    for ctx in ((), ("w1",), ("w1", "w2"), (None, None)):
        if model.total[ctx]:
            rest = sum(d * k for d, k in zip(model.d[len(ctx) + 1], model.kinds[ctx])) / model.total[ctx]
            unseen = rest
            for m in range(len(ctx)):
                low = ctx[m + 1 :]
                unseen *= sum(d * k for d, k in zip(model.d[len(low) + 1], model.kinds[low])) / model.total[low]
            assert math.isclose(sum(model.p((*ctx, w)) for (w,) in model.c[1]) + unseen * model.p(()), 1, abs_tol=1e-9)


def test_band_loses_no_text():
    # texts put together from repeated sequences in the worst way: abutting, each of exactly 8 words
    rng = random.Random(5)
    for order in (2, 3, 8):
        for _ in range(200):
            n = rng.randint(50, 200)
            w = [rng.randrange(30 if rng.random() < 0.3 else 10_000) for _ in range(n)]
            for at in range(16, n - 8, 8):
                if rng.random() < 0.9:
                    begin = rng.randrange(0, at - 8)
                    w[at : at + 8] = w[begin : begin + 8]
            each = grams(w, order)
            old = sum(g in each[:k] for k, g in enumerate(each))
            for share in (20, 40, 60):
                if repeated(w) * 100 >= share * n:
                    assert old >= repetition.fewest_old(np.array([n]), share, order)[0]


def test_few_documents_are_chosen(spark, data):
    s = repetition.scores(spark.read.parquet(f"{data}/documents.parquet")).cache()
    true = s.where("n_words >= 50 and repeated * 100 >= n_words * 60")
    n, chosen, cases = s.count(), s.where("chosen").count(), true.count()
    assert cases and true.where("not chosen").isEmpty() and cases <= chosen < n / 4
    s.unpersist()


def test_judged(spark):
    df = spark.createDataFrame([(i, t, ["en", "EN", "en-XA", None, "und", "de"][i % 6]) for i, t in enumerate(corpus(1))], "doc_id bigint, text string, lang string")
    rows = repetition.judged(df).collect()
    assert len(rows) == len(corpus(1)) and {r["lang"] for r in rows} == {"en", "und", "de"}
    for r in rows:
        if r["n_words"]:
            want = "low" if r["perplexity"] < r["low"] else "high" if r["perplexity"] > r["high"] else "ok"
            assert r["verdict"] == want and 0 <= r["repeated_share"] <= r["known_share"] <= 1
        else:
            assert r["verdict"] == "empty"


def test_copies_of_a_whole_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i", "en")] * 3, "doc_id bigint, text string, lang string").repartition(3)
    rows = repetition.scores(df).collect()
    assert len(rows) == 3 and len({tuple(r) for r in rows}) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert repetition.scores(df).collect() == [] and repetition.repetitive(df).collect() == [] and repetition.judged(df).collect() == []
    nulls = spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id bigint, text string, lang string").withColumn("x", F.lit(1))
    assert [r["n_words"] for r in repetition.scores(nulls).collect()] == [0, 0]
