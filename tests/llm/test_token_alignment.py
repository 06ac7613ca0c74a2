import hashlib
import re
from collections import Counter

import corpus
import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from quillmart.llm import registry, token_alignment
from quillmart.llm.production import aligned_models
from quillmart.llm.token_alignment import Settings


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = aligned_models()
    one = Tokenizer.from_str(a.decode())
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_proto=b)


def plain(data, libraries):
    """Whole texts through the libraries, all links of all groups in lists."""
    one, two = libraries
    of_character = token_alignment.byte_characters()
    held, out = [], []
    for doc_id, text in data:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        a_bytes = [bytes(of_character[c] for c in one.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in a]
        pieces = [two.id_to_piece(i) for i in b]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces
        ]
        raw = (" " + (text or "")).encode()
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            a, b, a_bytes, b_bytes = [], [], [], []
        ends = [set(np.cumsum([len(x) for x in t]).tolist()) for t in (a_bytes, b_bytes)]
        both = ends[0] & ends[1]
        groups = [[[], []]]
        at = [0, 0]
        where = [0, 0]
        for end in sorted(both):
            for side, (ids, lengths) in enumerate(((a, a_bytes), (b, b_bytes))):
                while at[side] < end:
                    groups[-1][side].append(ids[where[side]])
                    at[side] += len(lengths[where[side]])
                    where[side] += 1
            groups.append([[], []])
        groups = groups[:-1]
        held.append((doc_id, a, b, groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    count = Counter(p for *_, links in held for p in set(links))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    for doc_id, a, b, groups, links in held:
        spelled = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append(
            (
                doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links),
                sum(count[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest() if a else "",
            )
        )
    return sorted(out, key=repr)


def got(df):
    return sorted(rows(df.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")), key=repr)


TEXTS = [
    "the cat sat", "The cat  sat on\n the   mat", " leading", "trailing ", "  ", " ", "\n", "", None, "été über señor",
    "\U0001f600\U0001f601 emoji ﬁn 12½", "a▁b c", "<s> </s> <unk> <|endoftext|> <0x0A>", "x" * 900, "a\tb\r\nc  d\x0be",
    "don't we'll I'M", "数字 和 汉字没有空格", "the cat sat", "1234567 89 0.5", "  two  blanks  ", "a b c   d", "nul\x00 byte",
    "x \n y \n\n z", "=====  ----- =====", "a b" * 50, "é café", "\x1c \x1d x",
]


def test_awkward_texts_in_small_chunks(spark, libraries):
    data = list(enumerate(TEXTS)) + [(3, TEXTS[3])] * 2 + [(None, "the cat")]
    docs = corpus.documents(spark, [(i, t, None, None) for i, t in data]).repartition(3)
    index = token_alignment.inverted(docs, *aligned_models(), settings=Settings(chunk_bytes=20))
    assert got(token_alignment.document_scores(index)) == plain(data, libraries)
    assert index.select("chunk").distinct().count() > 5


def test_pair_scores_count_documents_and_links(spark, libraries):
    data = [(1, "the the the the cat"), (2, "the cat"), (3, "cat the the"), (4, "dog")]
    docs = corpus.documents(spark, [(i, t, None, None) for i, t in data]).coalesce(1)
    scores = token_alignment.pair_scores(token_alignment.inverted(docs, *aligned_models(), settings=Settings(chunk_bytes=20)))
    one, two = libraries
    pair = (one.encode(" the").ids[0], two.encode("the")[0])
    found = {(r["a"], r["b"]): (r["documents"], r["links"], r["best"]) for r in scores.collect()}
    assert found[pair] == (3, 7, True)


def test_awkward_and_empty_tables(spark, libraries):
    docs = corpus.documents(spark)
    found = token_alignment.document_scores(token_alignment.inverted(docs, *aligned_models()))
    assert got(found) == plain([(i, t) for i, t, *_ in corpus.DOCS], libraries)
    none = token_alignment.inverted(corpus.no_documents(spark), *aligned_models())
    assert rows(token_alignment.document_scores(none)) == []


def test_bitmaps_return_their_members():
    rng = np.random.default_rng(2)
    for documents in (1, 9, 300, 5000):
        held = rng.random((40, documents)) < rng.random((40, 1)) ** 4
        row, document = np.nonzero(held)
        which, n, packed = token_alignment.bitmaps(row, document, documents)
        assert isinstance(packed, pa.Array) and n.sum() == held.sum()
        number, found = token_alignment.members(n, packed.to_pylist())
        assert sorted(zip(which[number].tolist(), found.tolist(), strict=True)) == list(
            zip(row.tolist(), document.tolist(), strict=True)
        )


def test_whole_texts_of_the_query_agree_with_the_libraries(spark, libraries):
    table = spark.read.parquet(f"{corpus.SF_DIR}/documents.parquet").select("doc_id", "text")
    found = registry.queries()["op13_token_alignment"](spark, corpus.SF_DIR).withColumnRenamed("doc_id", "id")
    assert got(found) == plain([tuple(r) for r in table.collect()], libraries)
