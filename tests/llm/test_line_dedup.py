import hashlib
import random
from collections import defaultdict

from conftest import rows
from corpus import SF_DIR, documents, no_documents, table, texts

from quillmart.llm import line_dedup, registry


def within_one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


def plain(docs, min_chars=16, short_repeats=False):
    """Texts without the lines that come earlier, every line compared with every other."""
    first, seen = {}, {}
    for i in sorted(docs):
        for n, line in enumerate(docs[i].split("\n")):
            if len(line) >= min_chars:
                first.setdefault(line, (i, n))
            elif short_repeats and line.strip(" \t\n\x0b\x0c\r"):
                seen.setdefault(line, (i, n))
    by_length = defaultdict(list)
    for line in first:
        by_length[len(line)].append(line)
    gone = {
        line
        for line in first
        for size in (len(line) - 1, len(line), len(line) + 1)
        for other in by_length[size]
        if first[other] < first[line] and within_one_edit(line, other)
    }
    return {
        i: "\n".join(
            line
            for n, line in enumerate(text.split("\n"))
            if seen.get(line, (i, n)) == (i, n) and (len(line) < min_chars or (first[line] == (i, n) and line not in gone))
        )
        for i, text in docs.items()
    }


def deduped(spark, docs):
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return dict(rows(line_dedup.dedup(table)))


def test_edited_lines_against_all_pairs(spark):
    rng = random.Random(9)
    alphabet = "abcde é\U0001f600"
    lines = ["".join(rng.choice(alphabet) for _ in range(rng.choice([15, 16, 17, 31, 32, 63, 64, 65, 128, 200]))) for _ in range(60)]
    docs = defaultdict(list)
    for n in range(500):
        line = list(rng.choice(lines))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(line))
            line[at : at + rng.choice([0, 1])] = rng.choice(["", rng.choice(alphabet)])
        docs[n % 37 - 5].append("".join(line))
    docs = {i: "\n".join(held) for i, held in docs.items()}
    got = deduped(spark, docs)
    assert got == plain(docs) and got != docs


def test_the_whole_table_against_a_plain_answer(spark):
    docs = texts(spark)
    assert dict(rows(line_dedup.dedup(table(spark, "documents")).select("doc_id", "text"))) == plain(docs)


def test_awkward_rows_and_clashing_columns(spark):
    docs = documents(spark)
    got = line_dedup.dedup(docs)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    prose = next(r["text"] for r in docs.collect() if r["doc_id"] == 6)
    assert len(kept) == 12 and (1, None) in kept and (2, "") in kept and (4, "short") in kept
    assert (6, prose) in kept and kept.count((7, "")) == 2
    assert (11, "###***!!!\n###***!!!") in kept  # too short to be compared
    assert rows(line_dedup.dedup(no_documents(spark))) == []


def test_rows_without_an_id_come_last(spark):
    line = "a line that is long enough"
    docs = spark.createDataFrame([(None, line), (5, line), (None, line + "!")], "doc_id long, text string")
    got = rows(line_dedup.dedup(docs))
    assert sorted(got, key=repr) == sorted([(5, line), (None, ""), (None, "")], key=repr)


def test_a_text_with_very_many_and_very_long_lines(spark):
    docs = {1: "\n".join(f"line number {i} of a long text" for i in range(3000)), 2: "x" * 30_000, 3: "x" * 30_001}
    got = deduped(spark, docs)
    assert got[2] == docs[2] and got[3] == ""
    assert got[1] == plain({1: docs[1]})[1]


def test_the_main_path_has_no_python(spark):
    plan = line_dedup.dedup(table(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_exact_repeats_of_short_lines_go_and_blank_lines_stay(spark):
    docs = {
        1: "Les.\n\n1.\na line that is long enough\nLes.\n  ",
        2: "\nLes.\n2.\na line that is long enougH\n\u00e9\n  ",
        3: "\u00e9\n1.\nnew\n\t",
    }
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert dict(rows(line_dedup.dedup(table, short_repeats=True))) == {
        1: "Les.\n\n1.\na line that is long enough\n  ",
        2: "\n2.\n\u00e9\n  ",
        3: "new\n\t",
    }


def test_the_query_leaves_no_repeat_of_any_length(spark):
    left, seen = {}, set()
    for i, text in sorted(plain(texts(spark)).items()):
        left[i] = []
        for line in text.split("\n"):
            if len(line) >= 16 or not line.strip() or line not in seen:
                left[i].append(line)
            seen.add(line)
    got = {r["doc_id"]: r["kept_sha256"] for r in registry.queries()["op9_line_dedup"](spark, SF_DIR).collect() if r["kept_sha256"]}
    assert got == {i: hashlib.sha256("\n".join(left[i]).encode()).hexdigest() for i in got}
    assert any(left[i] != t.split("\n") for i, t in plain(texts(spark)).items())
