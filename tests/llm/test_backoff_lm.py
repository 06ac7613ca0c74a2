import math
import re
import zlib
from collections import Counter

import corpus
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillmart.llm import backoff_lm, registry
from quillmart.llm.backoff_lm import Settings


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", lower), "</s>"]


def plain(data, learned, prior):
    """Scores from counts in dictionaries, by the recursion that defines them."""
    order = len(prior) + 1
    counts = Counter()
    for (_, text), learn in zip(data, learned, strict=True):
        t = tokens(text) if learn else []
        for k in range(1, order + 1):
            counts.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    words = {g: c for g, c in counts.items() if len(g) == 1 and g != ("<s>",)}
    n, v = sum(words.values()), len(words)

    def p(context, word):
        if not context:
            return (words.get((word,), 0) + 0.1) / (n + 0.1 * (v + 1))
        m = prior[len(context) - 1]
        return (counts[(*context, word)] + m * p(context[1:], word)) / (counts[context] + m)

    out = []
    for doc_id, text in data:
        t = tokens(text)
        score = sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(1, len(t)))
        base = sum(math.log10(p((), w)) for w in t[1:])
        known = sum((w,) in words for w in t[1:])
        out.append((doc_id, len(t) - 1, known, n, pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-9)))
    return out


def got(spark, data, may_learn, **settings):
    table = spark.createDataFrame(data, "doc_id long, text string")
    table = table.withColumns({c: F.lit(c) for c in ("id", "learn", "block", "part", "keys", "score")})
    found = backoff_lm.score_documents(table, may_learn, settings=Settings(**settings))
    return sorted(rows(found.drop("learned")), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


TEXTS = [
    "The cat sat on the mat", "the CAT sat", "a dog\tsat on\nthe cat\x0b\x0c\r", "unknown words the cat", "",
    None, " \n ", "the the the the cat", "Été ÉTÉ été x", "a  b\x1cc", "the cat sat on the mat and the cat sat",
]


@pytest.mark.parametrize("prior", [(2.0,), (3.0, 1.5), (8.0, 4.0, 0.5), ()])
def test_scores_of_every_order(spark, prior):
    data = list(enumerate(TEXTS))
    learned = [i % 3 != 0 for i, _ in data]
    found = got(spark, data, F.col("doc_id") % 3 != 0, prior=prior, block_bytes=40, part_grams=8)
    assert found == plain(data, learned, prior)


def test_probabilities_add_up_to_one(spark):
    """Over all words that may come first, with the unknown ones as one; the texts end after them."""
    data = [(0, "x y x"), (1, "x z"), (2, "y y x"), (3, "")]
    asked = [(10 + i, w) for i, w in enumerate(["x", "y", "z", "unknown"])]
    learned = [True] * len(data) + [False] * len(asked)
    prior = (1.5, 0.5)
    scores = {r[0]: 10 ** r[-1] for r in got(spark, data + asked, F.col("doc_id") < 10, prior=prior)}
    # The chance of the end after each word, by the recursion.
    n, v = 12, 4
    one = {w: (c + 0.1) / (n + 0.1 * (v + 1)) for w, c in {"x": 4, "y": 3, "z": 1, "unknown": 0, "end": 4}.items()}
    two = {w: (c + 1.5 * one["end"]) / (of + 1.5) for w, c, of in (("x", 2, 4), ("y", 0, 3), ("z", 1, 1), ("unknown", 0, 0))}
    three = {"x": (0 + 0.5 * two["x"]) / (2 + 0.5), "y": (0 + 0.5 * two["y"]) / (1 + 0.5), "z": two["z"], "unknown": two["unknown"]}
    first = [scores[i] / three[w] for i, w in asked]
    assert sum(first) + scores[3] == pytest.approx(1)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    texts = [corpus.LONG.encode(), b"", b"One two", b"x" * 700, (b"ab " * 300) + b"c" * 500 + b" d"]
    whole = backoff_lm.hashed_words(texts)
    monkeypatch.setattr(backoff_lm, "PIECE", 64)
    parts = backoff_lm.hashed_words(texts)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
    assert whole[1].tolist() == [len(t.split()) for t in texts]


def test_awkward_and_empty_tables(spark):
    docs = corpus.documents(spark)
    found = backoff_lm.score_documents(docs, F.col("doc_id") % 2 == 0)
    data = [(i, text) for i, text, *_ in corpus.DOCS]
    expected = plain(data, [i is not None and i % 2 == 0 for i, _ in data], Settings().prior)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(rows(found.drop("learned")), key=key) == sorted(expected, key=key)
    assert rows(backoff_lm.score_documents(corpus.no_documents(spark), F.lit(True))) == []
    nothing = got(spark, [(1, "a b")], F.lit(False))
    assert nothing == plain([(1, "a b")], [False], Settings().prior)


def test_query_agrees_with_counts_in_dictionaries(spark):
    table = spark.read.parquet(f"{corpus.SF_DIR}/documents.parquet").select("doc_id", "text")
    data = sorted(map(tuple, table.collect()))
    learned = [zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in data]
    found = registry.queries()["op11_backoff_lm"](spark, corpus.SF_DIR)
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted(rows(found.select(columns))) == plain(data, learned, Settings().prior)
    held_out = {r["doc_id"]: r["held_out"] for r in found.collect()}
    assert held_out == {i: not learn for (i, _), learn in zip(data, learned, strict=True)}
