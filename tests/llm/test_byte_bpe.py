import base64

import tiktoken
from conftest import rows
from corpus import DOCS, LONG, documents, no_documents, table

from quillmart.llm import byte_bpe
from quillmart.llm.production import vocabulary


def plain(ranks, pattern):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def test_awkward_texts_encode_as_the_library_does(spark):
    ranks, pattern = vocabulary()
    enc = plain(ranks, pattern)
    got = byte_bpe.encode_documents(documents(spark), ranks, pattern).select("doc_id", "ids", "decoded")
    expected = [(i, enc.encode_ordinary(t or ""), bytearray((t or "").encode())) for i, t, *_ in DOCS]
    assert sorted(rows(got), key=repr) == sorted(expected, key=repr)
    assert rows(byte_bpe.digests(no_documents(spark), ranks, pattern)) == []


def test_output_names_replace_columns_of_that_name(spark):
    ranks, pattern = vocabulary()
    docs = documents(spark).withColumn("ids", F_lit("x")).filter("doc_id = 4")
    got = byte_bpe.encode_documents(docs, ranks, pattern)
    assert got.columns.count("ids") == 1 and got.first()["decoded"] == b"short"
    again = byte_bpe.decode_documents(got, ranks, pattern)
    assert again.first()["decoded"] == b"short" and again.first()["row"] == "row"


def F_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_pieces_of_long_texts_encode_like_the_whole(spark):
    ranks, pattern = vocabulary()
    enc = plain(ranks, pattern)
    for text in (LONG, "x" * 3000 + " " + "don't 12 " * 500, "é \n \n" * 2000, "  \n a" * 900):
        parts = list(byte_bpe.pieces(text, 100))
        assert "".join(parts) == text
        assert byte_bpe.ids_of(text, enc, 100).tolist() == enc.encode_ordinary(text)


def test_whole_table_round_trip(spark):
    docs = table(spark, "documents")
    coded = byte_bpe.encode_documents(docs, *vocabulary())
    assert coded.filter("decoded <> CAST(text AS BINARY)").count() == 0
    assert coded.count() == docs.count()
