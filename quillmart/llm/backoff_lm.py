"""Language-model scores of whole texts by a weighted backoff automaton.

Texts are lower-cased in ASCII and cut into words at ASCII white space; every text ends with a token of its
own, and starts in a state of its own. The n-grams of the texts that may be learned from are counted, and a
Dirichlet prior smooths the counts: with ``c`` the count and ``m`` the prior's weight,

    p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m),    h' = h without its first word,

down to single words, p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)) for N tokens, V of them different. Every n-gram
that was learned is a state; it has an arc for each word seen after it, of weight log10 p, and a failure arc to
the n-gram without its first word, of weight log10 (m / (c(h) + m)). One traversal from left to right carries
the state, follows failure arcs until a state has an arc for the next word, and adds up the weights.

The model grows with the corpus and is never in one place. Texts are dealt into blocks of about ``block_bytes``.
A block sends the hashes of its different n-grams, with their counts where they may be learned from, to parts by
hash; a part adds up the counts of an n-gram and returns them to the blocks that asked, in the order they asked
in; a block builds the part of the automaton that its texts can reach. An n-gram costs one number for each block
it is in, so that the most frequent one has as many as there are blocks, however often it occurs.

Words and n-grams are told apart by 64-bit hashes. Defined results: a NULL text is an empty text, which has the
end token alone. Texts of any length are scored whole; they are hashed a megabyte at a time, at white space, and
a text makes its block as large as it is. Repeated rows count as often as they are there and get equal results.
If nothing may be learned from, all counts are 0 and all scores follow from that. An empty table gives an empty
result. Only the id, the text and the condition are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.llm.anchors import Sums, mixed
from quillmart.llm.common import quoted, slices

U = np.uint64
BEGIN, END = U(0xB5297A4D3F84D5B5), U(0x68E31DA4C761BDA9)
FACTOR = U(0x9E3779B97F4A7C15)
SPACE = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20  # bytes that are hashed at a time
TALLY = 1 << 20  # different words a task holds before it sends them on


@dataclass(frozen=True)
class Settings:
    """What the model and its distribution depend on."""

    prior: tuple[float, ...] = (64.0,)  # weight of the prior, for n-grams of 2 words, 3 words, ...
    added: float = 0.1  # to the count of every word
    block_bytes: int = 8 << 20
    part_grams: int = 1 << 18

    @property
    def order(self) -> int:
        return 1 + len(self.prior)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text."""
    found, counts = [np.zeros(0, U)], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owners: list[int] = []

    def flush() -> None:
        data = np.frombuffer(b" ".join([*held, b""]), np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        space = np.concatenate([[True], space])
        starts = np.flatnonzero(space[:-1] & ~space[1:])
        ends = np.flatnonzero(~space[:-1] & space[1:])
        found.append(Sums(data).hashes(starts, ends))
        first = np.cumsum([0, *(len(p) + 1 for p in held)])
        np.add.at(counts, np.array(owners), np.diff(np.searchsorted(starts, first)))
        held.clear(), owners.clear()

    size = 0
    for i, text in enumerate(texts):
        text, at = text.lower(), 0  # of bytes: ASCII letters alone
        while at < len(text) or at == 0:
            cut = SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = cut.start() if cut else len(text)
            held.append(text[at:end]), owners.append(i)
            size += end - at + 1
            at = max(end, 1)
            if size >= PIECE:
                flush()
                size = 0
    if held:
        flush()
    return np.concatenate(found), counts


@dataclass(frozen=True)
class Grams:
    """The n-grams of some texts. Place 0 of each text is its begin, the last its end."""

    first: np.ndarray  # place of each text's begin, and the number of places
    keys: list[np.ndarray]  # for 1 word, 2 words, ...: hashes of the different n-grams, sorted
    learned: list[np.ndarray]  # how often each is in a text that may be learned from
    at: list[np.ndarray]  # per place: number of the n-gram that ends there, -1 where the text has begun too late


def grams_of(texts: list[bytes], learn: np.ndarray, order: int) -> Grams:
    words, counts = hashed_words(texts)
    first = np.concatenate([[0], np.cumsum(counts + 2)])
    h = np.full(first[-1], END)
    h[first[:-1]] = BEGIN
    inside = np.ones(len(h), bool)
    inside[first[:-1]] = inside[first[1:] - 1] = False
    h[inside] = words
    text = np.repeat(np.arange(len(texts)), counts + 2)
    place = np.arange(len(h)) - first[text]
    keys, learned, at = [], [], []
    own = mixed(h)
    for k in range(1, order + 1):
        if k > 1:
            with np.errstate(over="ignore"):
                own = np.concatenate([own[:1], mixed(own[:-1] * FACTOR + h[1:] + U(k))])
        there = np.flatnonzero(place >= k - 1)
        unique, number = np.unique(own[there], return_inverse=True)
        keys.append(unique)
        learned.append(np.bincount(number, learn[text[there]], len(unique)).astype(np.int64))
        numbers = np.full(len(h), -1, np.int64)
        numbers[there] = number
        at.append(numbers)
    return Grams(first, keys, learned, at)


def dealt(grams: Grams, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all n-grams by part and hash, and where each part starts."""
    keys = np.concatenate(grams.keys)
    part = keys % U(parts)
    order = np.lexsort((keys, part))
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=U))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs; the first byte says how many."""
    wide = np.ascontiguousarray(numbers, "<u8")
    width = max(1, -(-int(wide.max(initial=0)).bit_length() // 8))
    return bytes([width]) + wide.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    narrow = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, : data[0]] = narrow
    return wide.view("<u8").ravel()


@dataclass(frozen=True)
class Automaton:
    """States are numbered from 0, the root, arcs by their n-grams, all lengths in one row."""

    level: list[int]  # words of a state
    fail_to: list[int]
    fail_weight: list[float]
    to: list[int]  # of an arc
    weight: list[float]
    start: int

    def traverse(self, arcs: list[list[int]], begin: int, end: int) -> float:
        """Sum of the weights from the start state on.

        ``arcs`` holds for each length the arc that an n-gram of it, ending at a place, is; -1 if it is none.
        """
        level, fail_to, fail_weight, to, weight = self.level, self.fail_to, self.fail_weight, self.to, self.weight
        state, total = self.start, 0.0
        for i in range(begin, end):
            arc = arcs[level[state]][i]
            while arc < 0:
                total += fail_weight[state]
                state = fail_to[state]
                arc = arcs[level[state]][i]
            total += weight[arc]
            state = to[arc]
        return total


def automaton(grams: Grams, count: list[np.ndarray], n: int, v: int, s: Settings) -> tuple[Automaton, list[list[int]]]:
    """The states and arcs that the texts of ``grams`` can reach, and the arcs of all places."""
    # An n-gram's last word, its context and what is left without its first word, from one place it is at.
    where = []
    for numbers, keys in zip(grams.at, grams.keys, strict=True):
        place = np.zeros(len(keys), np.int64)
        place[numbers[numbers >= 0]] = np.flatnonzero(numbers >= 0)
        where.append(place)
    ends = np.zeros(grams.first[-1], bool)
    ends[grams.first[1:] - 1] = True
    n_states, state = 1, []
    for k in range(s.order - 1):
        is_state = (count[k] > 0) & ~ends[where[k]]
        number = np.where(is_state, n_states - 1 + np.cumsum(is_state), 0)
        n_states += int(is_state.sum())
        state.append(number)
    level, fail_to = np.zeros(n_states, np.int64), np.zeros(n_states, np.int64)
    fail_weight = np.zeros(n_states)
    share = [(count[0] + s.added) / (n + s.added * (v + 1))]
    to = [state[0] if state else np.zeros(len(share[0]), np.int64)]
    for k in range(1, s.order):
        m = s.prior[k - 1]
        context = grams.at[k - 1][where[k] - 1]
        rest = grams.at[k - 1][where[k]]
        share.append((count[k] + m * share[k - 1][rest]) / (count[k - 1][context] + m))
        to.append(np.where(state[k] > 0, state[k], state[k - 1][rest]) if k < s.order - 1 else state[k - 1][rest])
        known = state[k - 1] > 0
        own = state[k - 1][known]
        level[own] = k
        fail_weight[own] = np.log10(m / (count[k - 1][known] + m))
        if k > 1:
            fail_to[own] = state[k - 2][grams.at[k - 2][where[k - 1][known]]]
    arcs, before = [], 0
    for k in range(s.order):
        # A single word always has an arc, from the root.
        there = np.append((count[k] > 0) | (k == 0), False)[grams.at[k]]
        arcs.append(np.where(there, grams.at[k] + before, -1).tolist())
        before += len(grams.keys[k])
    start = 0
    if len(grams.first) > 1 and state:
        start = int(state[0][grams.at[0][0]])
    weight = np.log10(np.concatenate(share))
    model = Automaton(
        level.tolist(), fail_to.tolist(), fail_weight.tolist(), np.concatenate(to).tolist(), weight.tolist(), start
    )
    return model, arcs


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, number = np.unique(keys, return_inverse=True)
    return unique, np.bincount(number, n, len(unique)).astype(np.int64)


def vocabulary(rows: DataFrame) -> tuple[int, int, int]:
    """Tokens of all texts, tokens of those that may be learned from, and how many of these are different."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, every = np.zeros(0, U), np.zeros(0, np.int64), 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

        for batch in (part for batch in batches for part in slices(batch, 0, 1 << 23)):
            words, counts = hashed_words(batch.column(0).to_pylist())
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            every += len(words) + len(learn)
            own = words[np.repeat(learn, counts)]
            keys, n = _merged(
                np.concatenate([keys, own, [END]]), np.concatenate([n, np.ones(len(own), np.int64), [learn.sum()]])
            )
            if len(keys) > TALLY:
                yield sent()
                keys, n = keys[:0], n[:0]
        yield sent()
        # A row without a key: all tokens.
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([every])], names=["key", "n"])

    sums = rows.select("text", "learn").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    word = F.col("key").isNotNull() & (F.col("n") > 0)
    found = sums.agg(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.sum(F.when(word, F.col("n"))), F.count(F.when(word, 1)))
    return tuple(x or 0 for x in found.first())


def score_documents(
    docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None
) -> DataFrame:
    """Per row: ``id``, ``learned``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Scores are log10 probabilities of the whole text, ``base_score`` by single words, ``score`` by the model.
    """
    s = settings or Settings()
    rows = docs.select(
        F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("text"),
        F.coalesce(may_learn, F.lit(False)).alias("learn"), quoted(id_col).alias("id"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    every, n, v = vocabulary(rows)
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(n_bytes / s.block_bytes))
    parts = max(1, math.ceil(every * s.order / s.part_grams))
    # The number of the input partition keeps rows that repeat an id and a text from filling one block.
    block = F.pmod(F.xxhash64(F.col("id").cast("string"), "text", F.spark_partition_id()), F.lit(blocks)).cast("int")
    in_blocks = rows.select("text", "learn", "id", block.alias("block"))

    def read(table: pa.Table) -> Grams:
        learn = table["learn"].to_numpy().astype(np.int64)
        return grams_of(table["text"].to_pylist(), learn, s.order)

    def ask(table: pa.Table) -> pa.Table:
        """A row for each part: hashes of n-grams, as steps from one to the next, and their counts."""
        grams = read(table)
        order, starts = dealt(grams, parts)
        # Hashes of a part agree in the remainder.
        keys = np.concatenate(grams.keys)[order] // U(parts)
        learned = np.concatenate(grams.learned)[order]
        some = np.flatnonzero(np.diff(starts))
        cells = [slice(starts[p], starts[p + 1]) for p in some]
        columns = [
            pa.array(some.astype(np.int32)), pa.array(np.full(len(some), table["block"][0].as_py(), np.int32)),
            pa.array([packed(np.diff(keys[c], prepend=U(0))) for c in cells], pa.binary()),
            pa.array([packed(learned[c]) for c in cells], pa.binary()),
        ]
        return pa.Table.from_arrays(columns, names=["part", "block", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        """The counts of every block's n-grams over all blocks, in the block's order."""
        keys = [np.cumsum(unpacked(x), dtype=U) for x in table["keys"].to_pylist()]
        counts = np.concatenate([unpacked(x) for x in table["counts"].to_pylist()])
        unique, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, counts, len(unique)).astype(np.int64)[number]
        ends = np.cumsum([0, *map(len, keys)])
        totals = pa.array([packed(total[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
        return pa.Table.from_arrays([table["part"], table["block"], totals], names=["of_part", "of_block", "totals"])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams = read(texts)
        order, _ = dealt(grams, parts)
        count = np.zeros(len(order), np.int64)
        totals = [unpacked(x) for x in answers.sort_by("of_part")["totals"].to_pylist()]
        if totals:
            count[order] = np.concatenate(totals)
        counts = np.split(count, np.cumsum([len(k) for k in grams.keys])[:-1])
        model, arcs = automaton(grams, counts, n, v, s)
        places = np.arange(grams.first[-1])
        word = ~np.isin(places, grams.first[:-1])
        text = np.repeat(np.arange(len(grams.first) - 1), np.diff(grams.first))[word]
        own = counts[0][grams.at[0][word]]
        base = np.log10((own + s.added) / (n + s.added * (v + 1)))
        n_texts = len(grams.first) - 1
        scores = [model.traverse(arcs, a + 1, b) for a, b in zip(grams.first.tolist(), grams.first[1:].tolist(), strict=False)]
        columns = [
            texts["id"], texts["learn"], pa.array(np.diff(grams.first) - 1),
            pa.array(np.bincount(text, own > 0, n_texts).astype(np.int64)),
            pa.array(np.bincount(text, base, n_texts)), pa.array(scores, pa.float64()),
        ]
        return pa.Table.from_arrays(columns, names=["id", "learned", "n_tokens", "n_known", "base_score", "score"])

    asked = in_blocks.groupBy("block").applyInArrow(ask, "part int, block int, keys binary, counts binary")
    answered = asked.groupBy("part").applyInArrow(answer, "of_part int, of_block int, totals binary")
    scored = in_blocks.groupBy("block").cogroup(answered.groupBy("of_block")).applyInArrow(
        score, f"id {kind}, learned boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(n).cast("long")).select(
        "id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
