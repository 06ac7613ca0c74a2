"""Aligning the tokens of two tokenizers over a corpus, by inverted bitmaps of id pairs.

A is a byte-level BPE, B a sentencepiece model. Byte offsets at which tokens of both end cut a text's tokens into
groups; every A token of a group is linked with every B token of it. An id pair is scored by the number of
documents that hold it linked, and by the number of its links.

Documents are taken in chunks of about ``chunk_bytes`` of text. Neither tokenizer joins what a blank after a
character that is no white space cuts, so texts are cut there, every different cut is tokenized and aligned once
a chunk, and no group crosses a cut. For each pair of a chunk a compressed bitmap says which of the chunk's
documents hold it: a list of numbers, or bits where these are fewer bytes. The pair's further links in a document,
one less than all of them, are written in binary, a bitmap for each binary place (the multiplicity planes). The
bitmaps of different chunks are of different documents, so their union's popcount is the sum of theirs: pairs are
counted by that, and by planes weighted with their place. Bitmaps then meet their pair's score, go back to their
chunk, and add the score to every document in them. A pair costs a bitmap for each chunk it is in, so that the
most frequent one is spread over as many rows as there are chunks.

Defined results: a NULL or empty text, and one that either tokenizer does not give back byte by byte, has no
tokens; all its numbers are 0 and the digest is ''. Special tokens in a text are plain text. Texts are read whole;
one longer than a chunk is a chunk of its own, and a run without a blank is tokenized as a whole. Ties for an A
id's highest count are all best. Repeated rows count as often as they are there and get equal results. An empty
table gives an empty result. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import quoted, slices, stored

CUT = re.compile(r"(?<=\S)(?= )")
UNCUT = re.compile(r"\s ")
BLANK = "▁"  # stands for a space in B's pieces
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
MOST_DOCUMENTS = 1 << 15  # of a chunk; their numbers take two bytes
MOST_PAIRS = 1 << 22  # expanded at a time
MOST_UNITS = 1 << 15  # tokenized at a time
ID_BITS = 20  # of a token's id
LOW = (1 << ID_BITS) - 1


@dataclass(frozen=True)
class Settings:
    """Size of a chunk."""

    chunk_bytes: int = 12 << 20


def read_model(path: str) -> bytes:
    """A tokenizer's file as it is: a vocabulary of a few MB at most, which is sent to the workers."""
    with open(path, "rb") as f:
        return f.read()


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the entries of a byte-level BPE: itself where it is
    printable, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens; built once per task."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of_character = byte_characters()
        entries = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            known = all(c in of_character for c in entry)
            a_bytes[i] = bytes(of_character[c] for c in entry) if known else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) else p.replace(BLANK, " ").encode() for p in pieces]
        # Bytes of every id, and their lengths.
        self.a_bytes, self.b_bytes = ((table, np.array([len(x) for x in table], np.int64)) for table in (a_bytes, b_bytes))
        if max(len(a_bytes), len(b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        # Blanks cut what either tokenizer joins only if A splits at them and no piece of B has one inside.
        split = json.loads(a)
        at_blanks = split.get("normalizer") is None and (split.get("pre_tokenizer") or {}).get("use_regex", False)
        self.cuts = at_blanks and not any(CUT.search(p.replace(BLANK, " ")) for p in pieces)
        self.blank = self.b.piece_to_id(BLANK)

    def units(self, text: str) -> list[str]:
        """Space and text, in parts that begin with a space."""
        whole = " " + text
        if not self.cuts:
            return [whole]
        # Without white space before a blank, every blank is a cut.
        return CUT.split(whole) if UNCUT.search(whole) else [" " + p for p in text.split(" ")]

    def encode(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of A and of B, side by side, their numbers for each part, and the bytes of the parts.

        A part that either tokenizer does not give back byte by byte has none.
        """
        a = [x.ids for x in self.a.encode_batch(units, add_special_tokens=False)]
        # B adds the first space itself, but not to nothing.
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        b = [[self.blank] if u == " " else ids for u, ids in zip(units, b, strict=True)]
        raw = [u.encode() for u in units]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sides = [(*_flat(ids), table, lengths) for ids, table, lengths in ((a, *self.a_bytes), (b, *self.b_bytes))]
        joined, last = b"".join(raw), np.cumsum(size)
        for ids, n, table, lengths in sides:
            ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.cumsum(n)]
            if not np.array_equal(ends, last) or b"".join(map(table.__getitem__, ids.tolist())) != joined:
                break
        else:
            return [x[0] for x in sides], [x[1] for x in sides], size
        for i, own in enumerate(raw):
            if any(b"".join(map(table.__getitem__, ids[i])) != own for ids, (table, _) in ((a, self.a_bytes), (b, self.b_bytes))):
                a[i], b[i], size[i] = [], [], 0
        sides = [_flat(a), _flat(b)]
        return [x[0] for x in sides], [x[1] for x in sides], size


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, n.sum()), n


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in their order, and the sum of each one's weights. Keys almost in order are fast."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


@dataclass(frozen=True)
class Aligned:
    """What the different parts of a chunk's texts hold."""

    good: np.ndarray  # both tokenizers give the part back
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    spelled: list[str]  # the groups, each ending with a semicolon
    n_pairs: np.ndarray
    pair: np.ndarray  # A id, then B id in the lower bits
    times: np.ndarray


def align(units: list[str], tokenizers: Tokenizers) -> Aligned:
    ids, n, size = tokenizers.encode(units)
    lengths = tokenizers.a_bytes[1], tokenizers.b_bytes[1]
    ends = [np.cumsum(of[own]) for of, own in zip(lengths, ids, strict=True)]
    good, last = n[0] > 0, np.cumsum(size)
    common = np.intersect1d(*ends, assume_unique=True)  # the ends of the groups
    group = [np.searchsorted(common, e) for e in ends]
    in_group = [np.bincount(g, minlength=len(common)) for g in group]
    unit = np.searchsorted(last, common)  # of each group
    links = in_group[0] * in_group[1]
    spelled = _spelled(group, in_group, ids, unit, len(units))
    # Different ids of each group, and the pairs of them.
    (key_a, times_a), (key_b, times_b) = (
        _sums(g << ID_BITS | own, np.ones(len(g), np.int64)) for g, own in zip(group, ids, strict=True)
    )
    of_a, of_b = (np.bincount(key >> ID_BITS, minlength=len(common)) for key in (key_a, key_b))
    start_a, start_b = (np.cumsum(x) - x for x in (of_a, of_b))
    cells = of_a * of_b
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for part in _parts(cells, MOST_PAIRS):
        g = np.repeat(part, cells[part])
        at = np.arange(len(g)) - np.repeat(np.cumsum(cells[part]) - cells[part], cells[part])
        i, j = start_a[g] + at // of_b[g], start_b[g] + at % of_b[g]
        pair = (key_a[i] & LOW) << ID_BITS | (key_b[j] & LOW)
        held.append(_sums(unit[g] << 2 * ID_BITS | pair, times_a[i] * times_b[j]))
    key, times = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
    whose, pair = key >> 2 * ID_BITS, key & (LOW << ID_BITS | LOW)
    first = np.searchsorted(whose, np.arange(len(units) + 1))
    per_unit = lambda w: np.bincount(unit, w, len(units)).astype(np.int64)
    return Aligned(good, n[0], n[1], per_unit(np.ones(len(unit))), per_unit(links), spelled, np.diff(first), pair, times)


def align_all(units: list[str], tokenizers: Tokenizers) -> Aligned:
    """``align`` for some parts at a time."""
    found = [align(units[i : i + MOST_UNITS], tokenizers) for i in range(0, max(1, len(units)), MOST_UNITS)]
    joined = {name: [getattr(x, name) for x in found] for name in Aligned.__dataclass_fields__}
    return Aligned(**{k: sum(v, []) if k == "spelled" else np.concatenate(v) for k, v in joined.items()})


def _parts(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Numbers of rows in runs whose sizes add up to about ``most``."""
    run = (np.cumsum(sizes) - sizes) // most
    return (x for x in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(run)) + 1) if len(x))


def _spelled(group: list[np.ndarray], in_group: list[np.ndarray], ids: list[np.ndarray], unit: np.ndarray, n: int) -> list[str]:
    """The groups of each part as text: A ids, a bar, B ids, a semicolon."""
    both = in_group[0] + in_group[1]
    start = np.cumsum(both) - both
    out = np.empty(int(both.sum()), object)
    for side, mark in ((0, "|"), (1, ";")):
        before = np.cumsum(in_group[side]) - in_group[side]
        at = np.arange(len(ids[side])) - before[group[side]]
        place = start[group[side]] + at + (in_group[0][group[side]] if side else 0)
        is_last = at == in_group[side][group[side]] - 1
        out[place] = [f"{i}{mark if z else ','}" for i, z in zip(ids[side].tolist(), is_last.tolist(), strict=True)]
    # Where each part's tokens end.
    ends = np.cumsum(np.bincount(unit, both, n).astype(np.int64))
    tokens = out.tolist()
    return ["".join(tokens[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def bitmaps(row: np.ndarray, document: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Different rows, number of documents of each, and their bitmaps. Pairs of both are sorted.

    A bitmap of two bytes a document is a list of numbers; one of fewer bytes holds bits.
    """
    first = np.flatnonzero(np.diff(row, prepend=-1))
    n = np.diff(np.append(first, len(row)))
    as_bits = -(-documents // 8)
    dense = 2 * n > as_bits
    size = np.where(dense, as_bits, 2 * n)
    ends = np.cumsum(size)
    start = np.concatenate([[0], ends]).astype(np.int64)
    data = np.zeros(start[-1], np.uint8)
    whose = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - first[whose]
    bits = dense[whose]
    listed = ~bits
    place = start[whose[listed]] + 2 * at[listed]
    data[place], data[place + 1] = document[listed] & 255, document[listed] >> 8
    np.bitwise_or.at(data, start[whose[bits]] + (document[bits] >> 3), (1 << (document[bits] & 7)).astype(np.uint8))
    packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(start), pa.py_buffer(data)])
    return row[first], n, packed.cast(pa.binary())


def members(n: np.ndarray, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The reverse: numbers of bitmaps, and the documents in them."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    size = np.fromiter(map(len, packed), np.int64, len(packed))
    listed = np.flatnonzero(size == 2 * n)
    numbers = np.frombuffer(b"".join(packed[i] for i in listed.tolist()), "<u2").astype(np.int64)
    out.append((np.repeat(listed, n[listed]), numbers))
    for i in np.flatnonzero(size != 2 * n).tolist():
        found = np.flatnonzero(np.unpackbits(np.frombuffer(packed[i], np.uint8), bitorder="little"))
        out.append((np.full(len(found), i), found))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Numbers(dict):
    """Numbers of keys, in the order they come."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Chunk:
    """Documents of a chunk, and the different parts of their texts."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.numbers: list[np.ndarray] = []  # of each text's parts
        self.index = Numbers()
        self.size = 0

    def add(self, ids: pa.Array, texts: list[str], tokenizers: Tokenizers) -> None:
        self.ids.append(ids)
        for text in texts:
            units = tokenizers.units(text) if text else []
            self.numbers.append(np.fromiter(map(self.index.__getitem__, units), np.int64, len(units)))
            self.size += len(text)

    def rows(self, chunk: int, tokenizers: Tokenizers) -> Iterator[pa.RecordBatch]:
        """A row for each document, then one for each bitmap."""
        found = align_all(list(self.index), tokenizers)
        n_docs = len(self.numbers)
        own = [x if found.good[x].all() else x[:0] for x in self.numbers]
        total = lambda per_unit: np.array([per_unit[x].sum() for x in own], np.int64)
        digests = [
            hashlib.sha256("".join(map(found.spelled.__getitem__, x.tolist()))[:-1].encode()).hexdigest() if len(x) else ""
            for x in own
        ]
        columns = {
            "id": pa.concat_arrays(self.ids), "place": pa.array(np.arange(n_docs, dtype=np.int32)),
            "n_a": pa.array(total(found.n_a)), "n_b": pa.array(total(found.n_b)),
            "n_groups": pa.array(total(found.n_groups)), "n_links": pa.array(total(found.n_links)),
            "groups_sha256": pa.array(digests, pa.string()),
        }
        yield _batch(chunk, n_docs, columns, self.ids[0].type)
        # Links of a document: the pairs of its parts, as often as it has them.
        document = np.repeat(np.arange(n_docs), [len(x) for x in own])
        parts = np.concatenate([*own, np.zeros(0, np.int64)])
        key, often = _sums(document << 32 | parts, np.ones(len(parts), np.int64))
        document, unit = key >> 32, key & 0xFFFFFFFF
        pairs = np.unique(found.pair)
        number = np.searchsorted(pairs, found.pair)
        n, first = found.n_pairs[unit], np.cumsum(found.n_pairs) - found.n_pairs
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[unit], n)
        key, links = number[at] * MOST_DOCUMENTS + np.repeat(document, n), found.times[at] * np.repeat(often, n)
        del at
        key, links = _sums(key, links)
        row, document = key // MOST_DOCUMENTS, key % MOST_DOCUMENTS
        # The presence of a pair, then the planes of its further links.
        further = links - 1
        planes = [(0, links > 0)]
        planes += [(p + 1, (further >> p) & 1 == 1) for p in range(int(further.max(initial=0)).bit_length())]
        for plane, held in planes:
            which, count, packed = bitmaps(row[held], document[held], n_docs)
            columns = {
                "pair": pa.array(pairs[which]), "plane": pa.array(np.full(len(which), plane, np.int32)),
                "n": pa.array(count), "bits": packed,
            }
            yield _batch(chunk, len(which), columns, self.ids[0].type)


def _batch(chunk: int, n: int, columns: dict[str, pa.Array], id_type: pa.DataType) -> pa.RecordBatch:
    """Rows of a chunk; columns that are not given are NULL."""
    types = {
        "chunk": pa.int64(), "place": pa.int32(), "id": id_type, "n_a": pa.int64(), "n_b": pa.int64(),
        "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
        "pair": pa.int64(), "plane": pa.int32(), "n": pa.int64(), "bits": pa.binary(),
    }
    columns = {"chunk": pa.array(np.full(n, chunk, np.int64)), **columns}
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in types.items()], names=list(types))


def inverted(
    docs: DataFrame, a: bytes, b: bytes, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None
) -> DataFrame:
    """The documents and bitmaps of all chunks, stored.

    A document is its ``chunk``, ``place`` in it, ``id`` and numbers; a bitmap its ``chunk``, ``pair``, ``plane`` (0:
    documents that hold the pair; p: those whose further links have the binary place p - 1), ``n`` and ``bits``.
    """
    s = settings or Settings()
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizers, chunk = Tokenizers(a, b), Chunk()
        # Numbers of chunks stay, as the rows are written; another attempt of a task writes other files.
        number = TaskContext.get().partitionId() << 32
        for batch in (part for batch in batches for part in slices(batch, 1, min(1 << 20, s.chunk_bytes))):
            for start in range(0, batch.num_rows, MOST_DOCUMENTS):
                part = batch.slice(start, MOST_DOCUMENTS)
                if chunk.size >= s.chunk_bytes or len(chunk.numbers) + part.num_rows > MOST_DOCUMENTS:
                    yield from chunk.rows(number, tokenizers)
                    chunk, number = Chunk(), number + 1
                chunk.add(part.column(0), part.column(1).to_pylist(), tokenizers)
        if chunk.numbers:
            yield from chunk.rows(number, tokenizers)

    schema = (
        f"chunk long, place int, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pair long, plane int, n long, bits binary"
    )
    return stored(rows.mapInArrow(run, schema), "bitmaps")


def pair_scores(index: DataFrame) -> DataFrame:
    """Per id pair of an ``inverted`` result: ``pair``, ``a``, ``b``, ``documents``, ``links`` and whether it is the
    ``best`` of its A id, having the most documents."""
    weight = F.when(F.col("plane") > 0, F.expr("shiftleft(1L, plane - 1)")).otherwise(1)
    counted = index.filter("pair IS NOT NULL").groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("documents"),
        F.sum(F.col("n") * weight).alias("links"),
    )
    named = counted.select(
        "pair", F.shiftright("pair", ID_BITS).cast("int").alias("a"),
        F.col("pair").bitwiseAND(F.lit(LOW)).cast("int").alias("b"),
        "documents", "links",
    )
    # A row for each id of A: no more than its vocabulary has.
    most = named.groupBy("a").agg(F.max("documents").alias("most"))
    return named.join(F.broadcast(most), "a").select(
        "pair", "a", "b", "documents", "links", (F.col("documents") == F.col("most")).alias("best")
    )


def document_scores(index: DataFrame) -> DataFrame:
    """Per row: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    kind = index.schema["id"].dataType.simpleString()
    docs = index.filter("pair IS NULL").select(
        F.col("chunk").alias("of"), "place", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"
    )
    scores = pair_scores(index).select("pair", "documents", "best")
    returned = index.filter("pair IS NOT NULL").select("chunk", "pair", "plane", "n", "bits").join(scores, "pair").drop("pair")

    def total(docs: pa.Table, found: pa.Table) -> pa.Table:
        """Scores of a chunk's bitmaps, added up over the documents in them."""
        place = docs["place"].to_numpy()
        best, counts = (np.zeros(int(place.max(initial=-1)) + 1, np.int64) for _ in range(2))
        for batch in found.to_batches(max_chunksize=1 << 16):
            number, document = members(batch["n"].to_numpy(), batch["bits"].to_pylist())
            weight = np.int64(1) << np.maximum(batch["plane"].to_numpy().astype(np.int64) - 1, 0)
            is_best = batch["best"].to_numpy(zero_copy_only=False)
            np.add.at(best, document, (weight * is_best)[number])
            np.add.at(counts, document, (weight * batch["documents"].to_numpy())[number])
        columns = [docs[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
        columns += [pa.array(best[place]), pa.array(counts[place]), docs["groups_sha256"]]
        return pa.Table.from_arrays(columns, names=[*"id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()])

    return docs.groupBy("of").cogroup(returned.groupBy("chunk")).applyInArrow(
        total,
        f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
