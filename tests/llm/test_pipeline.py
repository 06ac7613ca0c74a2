import base64

import pytest
import tiktoken
from conftest import rows
from corpus import SF_DIR, documents, no_documents, table

import corpus_pipeline
from quillmart.llm import registry
from quillmart.llm.production import vocabulary


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What every stage keeps, written and read again."""
    docs, out = table(spark, "documents"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        kept = stage(spark, docs, SF_DIR)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append({r["doc_id"]: r for r in docs.collect()})
        assert len(out[-1]) == docs.count()
    return out


def test_stages_come_in_order_and_only_take_away(spark, staged):
    assert [len(s) for s in staged] == sorted((len(s) for s in staged), reverse=True)
    first = {r["doc_id"]: r for r in table(spark, "documents").collect()}
    assert set(staged[0]) <= set(first)
    assert len(staged[0]) >= 0.98 * len(first)  # clean documents stay
    assert staged[-1]


def test_stages_against_plain_answers(spark, staged):
    from test_line_dedup import plain
    from test_order_minhash import classes, similar_pairs

    language, lines, near = ({i: r["text"] for i, r in s.items()} for s in staged[:3])
    expected = {i: t for i, t in plain(language, short_repeats=True).items() if t.strip()}
    assert lines == expected
    assert all(r["n_chars"] == len(r["text"]) for r in staged[1].values())
    of = classes(similar_pairs(lines), lines)
    assert set(near) == {i for i in lines if of[i] == i}
    assert all(staged[3][i]["text"] == near[i] for i in staged[3])


def test_tokens_are_those_of_the_library(staged):
    ranks, pattern = vocabulary()
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    enc = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    assert set(staged[4]) == set(staged[3])
    for i, r in staged[4].items():
        assert r["decodes"] and r["ids"] == enc.encode_ordinary(staged[3][i]["text"]) and r["n_tokens"] == len(r["ids"])


@pytest.mark.parametrize("stage", [s[0] for s in corpus_pipeline.STAGES])
def test_awkward_and_empty_tables(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (documents(spark), no_documents(spark)):
        docs = docs.withColumn("n_chars", docs["doc_id"])
        got = run(spark, docs, SF_DIR)
        assert set(names) <= set(got.columns) or stage == "byte bpe"
        assert got.count() <= 12 and (docs.count() > 0 or rows(got) == [])


def test_every_operator_has_a_query():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert corpus_pipeline.ORACLE_SQL is None
