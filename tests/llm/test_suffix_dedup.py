import random

import numpy as np
import pytest
from conftest import rows
from corpus import documents, no_documents, random_words, table, texts
from pyspark.sql import functions as F

from quillmart.llm import anchors, suffix_dedup

WINDOW = 200


def plain(docs):
    """Kept bytes and removed runs, from all windows of all texts; docs is a list of byte strings."""
    count = {}
    for text in docs:
        for i in range(len(text) - WINDOW + 1):
            window = text[i : i + WINDOW]
            count[window] = count.get(window, 0) + 1
    out = []
    for text in docs:
        covered = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - WINDOW + 1):
            if count[text[i : i + WINDOW]] > 1:
                covered[i : i + WINDOW] = True
        kept = bytes(b for b, c in zip(text, covered, strict=False) if not c)
        out.append((len(text), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), kept))
    return out


def deduped(spark, docs, settings=None):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = suffix_dedup.dedup(table, settings=settings).orderBy("id").collect()
    return [(r["n_bytes"], len(r["low"]), bytes(r["kept"])) for r in got]


def passages(seed):
    rng, words = random.Random(seed), random_words(seed, 300)
    shared = [" ".join(rng.choices(words, k=60)) for _ in range(4)]
    out = []
    for i in range(60):
        parts = [" ".join(rng.choices(words, k=rng.choice([5, 30, 80])))]
        for _ in range(rng.choice([0, 1, 2])):
            passage = rng.choice(shared)
            parts += [passage[rng.choice([0, 3, 100]) :], " ".join(rng.choices(words, k=20))]
        out.append(" é ".join(parts))
    out += [out[3], out[3], "la " * 300, "la " * 90, "x" * 450, "y" * 200, "z" * 199, "z" * 199, "", "é" * 180]
    return out


@pytest.mark.parametrize("limits", [{}, {"bucket_contexts": 2}, {"group_bytes": 2000}])
def test_passages_against_all_windows(spark, limits):
    docs = passages(6)
    got = deduped(spark, docs, suffix_dedup.Settings(**limits))
    assert got == plain([t.encode() for t in docs])


def test_texts_looked_at_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 150)
    docs = passages(7)
    assert deduped(spark, docs) == plain([t.encode() for t in docs])


def test_whole_table_against_all_windows(spark):
    docs = sorted(texts(spark).items())
    got = {r["id"]: r for r in suffix_dedup.dedup(table(spark, "documents")).collect()}
    for (i, _), (n, spans, kept) in zip(docs, plain([t.encode() for _, t in docs]), strict=True):
        assert (got[i]["n_bytes"], len(got[i]["low"]), bytes(got[i]["kept"])) == (n, spans, kept)


def test_awkward_rows(spark):
    got = suffix_dedup.dedup(documents(spark)).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], []).append((r["n_bytes"], bytes(r["kept"])))
    assert len(got) == 12 and by_id[1] == by_id[2] == [(0, b"")]
    assert by_id[10] == [(5000, b"")] and by_id[4] == [(5, b"short")]
    assert len(by_id[7]) == 2 and by_id[7][0] == by_id[7][1]
    assert rows(suffix_dedup.dedup(no_documents(spark))) == []


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(1)
    texts_ = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 199, 200, 201, 1000, 5000)]
    found = anchors.find(texts_, WINDOW, 40)
    for i, text in enumerate(texts_):
        mine = found.text == i
        starts = (found.at - found.left)[mine]
        ends = (found.at + found.right)[mine]
        windows = [w for a, b in zip(starts, ends, strict=True) for w in range(a, b - WINDOW + 1)]
        assert windows == list(range(max(0, len(text) - WINDOW + 1)))


def test_the_first_of_equal_minima_is_taken():
    rng = np.random.default_rng(2)
    for n, width in ((50, 7), (50, 50), (51, 10), (5, 1)):
        x = rng.integers(0, 4, n).astype(np.uint64)
        expected = [i + int(np.argmin(x[i : i + width])) for i in range(n - width + 1)]
        assert anchors.first_minimum(x, width).tolist() == expected


def test_equal_rows_share_one_list_of_spans(spark):
    text = passages(9)[0] * 2
    table = spark.createDataFrame([(7, text)] * 500 + [(None, text)] * 500, "doc_id long, text string")
    spans = suffix_dedup.repeated_spans(table).distinct()
    assert spans.count() < 100
    got = suffix_dedup.dedup(table).select("id", "n_bytes", F.size("low"), F.length("kept"))
    assert got.distinct().count() == 2 and got.count() == 1000
    assert {tuple(r)[1:] for r in got.collect()} == {(len(text.encode()), 1, 0)}
