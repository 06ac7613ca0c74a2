"""Removing repeated passages: every byte covered by a string of ``window`` bytes that also starts elsewhere.

Suffixes are sorted one bucket at a time, as far as ``window`` bytes. All suffixes whose window has the same
anchor gram (see ``anchors``) make a bucket; equal windows fall into one bucket, at the same place relative to
the anchor. The text of a bucket is laid out so that anchors lie on a grid, and the places of the grid are
the cover sample: equal windows meet it at equal distances. Ranks of the sample by its next 32, 64, 128 and 160
bytes are computed once per bucket by doubling; suffixes are then sorted by the bytes before their first
sample place, by its rank, and by the bytes after. Neighbours that agree are repeated windows.

Most buckets need no sorting: an anchor whose gram is nowhere else has no repeated window, and of anchors whose
whole contexts, the bytes of all their windows, have equal hashes all windows are repeated. Only contexts that
differ within a bucket are sorted, each once. Buckets go to tasks in groups of about ``group_bytes``; one with
more than ``bucket_contexts`` different contexts is not gathered, and its windows are counted by two hashes
instead, so that no group grows with the data.

Defined results: a NULL text is an empty text; texts shorter than the window keep all bytes. Copies of a text
lose all bytes from the window's length on. Rows that repeat an id and a text count as several texts and get
equal results. An empty table gives an empty one. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm import anchors
from quillmart.llm.common import quoted, slices, stored

U = np.uint64
GRID = 32
RANKED = 160  # bytes the ranks of the sample tell apart
BITS = 1 << 26  # of the filter of grams that occur again; 8 MB whatever the data
BUCKETS = 1 << 19  # bound on the rows that are broadcast
PART = 1 << 20  # windows of a long text that are looked at together


@dataclass(frozen=True)
class Settings:
    """What windows, buckets and groups depend on."""

    window: int = 200  # RANKED + GRID + 8 at least
    gram: int = 40
    group_bytes: int = 1 << 22
    bucket_contexts: int = 20_000  # 8 MB of contexts at most, as a context has less than two windows


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(quoted(text_col), F.lit(""))
    return docs.select(text.cast("binary").alias("text"), quoted(id_col).alias("id"), F.xxhash64(text).alias("same"))


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[int], list[bytes]]]:
    """Batches with their texts, long ones in parts that share no window: numbers, offsets, parts."""
    for batch in (part for batch in batches for part in slices(batch, 0)):
        texts, rows, offsets, parts = batch.column(0).to_pylist(), [], [], []
        for i, text in enumerate(texts):
            for start in range(0, max(1, len(text) - window + 1), PART):
                rows.append(i), offsets.append(start), parts.append(text[start : start + PART + window - 1])
        yield batch, rows, offsets, parts


def _gram_filter(texts: DataFrame, s: Settings) -> np.ndarray:
    """A bit for the remainder of each anchor gram's hash that occurs more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, parts in _pieces(batches, s.window):
            yield pa.RecordBatch.from_arrays([pa.array(anchors.find(parts, s.window, s.gram).gram)], names=["gram"])

    often = texts.select("text").mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    place = F.pmod("gram", F.lit(BITS)) + 1
    maps = often.select(place.alias("place")).groupBy(F.expr("bitmap_bucket_number(place)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits")
    )
    out = np.zeros(BITS // 8, np.uint8)
    for r in maps.toLocalIterator():
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        start = (r["bucket"] - 1) * len(bits)
        out[start : start + len(bits)] = bits
    return out


def _repeated_anchors(texts: DataFrame, s: Settings) -> DataFrame:
    """Anchors whose gram may occur elsewhere: ``gram, context, size`` of the context, and where it is."""
    sent = texts.sparkSession.sparkContext.broadcast(_gram_filter(texts, s))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch, rows, offsets, parts in _pieces(batches, s.window):
            found = anchors.find(parts, s.window, s.gram)
            place = np.mod(found.gram, BITS)
            kept = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            text = found.text[kept]
            row = pa.array(np.array(rows, np.int64)[text])
            start = np.array(offsets, np.int64)[text] + found.at[kept] - found.left[kept]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.gram[kept]), pa.array(found.context[kept]),
                    pa.array(found.left[kept], pa.int32()), pa.array((found.left + found.right)[kept], pa.int32()),
                    batch.column(1).take(row), batch.column(2).take(row), pa.array(start),
                ],
                names=["gram", "context", "left", "size", "id", "same", "start"],
            )

    return texts.mapInArrow(run, f"gram long, context long, left int, size int, id {kind}, same long, start long")


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, in the order of the bytes."""
    out = np.zeros(len(data), U)
    for j in range(8):
        out[: len(data) - j] |= data[j:].astype(U) << U(56 - 8 * j)
    return out


def _named(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows of keys, the first key first; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _head(words: np.ndarray, at: np.ndarray, n: np.ndarray, most: int) -> list[np.ndarray]:
    """The ``n`` bytes from each place on, as numbers; bytes after them are 0."""
    out = []
    for j in range(0, most, 8):
        kept = np.clip(n - j, 0, 8)
        shift = ((8 - kept) * 8).astype(U)
        word = words[at + j]
        out.append(np.where(kept > 0, (word >> np.minimum(shift, U(63))) << np.minimum(shift, U(63)), U(0)))
    return out


def repeated_windows(
    contexts: list[bytes], left: np.ndarray, bucket: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and starts of the windows that another context of the bucket has at the same place."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    # Anchors on the grid, and free bytes behind every context.
    base = (-left) % GRID
    room = -(-(base + size + 2 * GRID) // GRID) * GRID
    base = base + np.concatenate([[0], np.cumsum(room)[:-1]])
    data = np.zeros(int(room.sum()) + 2 * window, np.uint8)
    joined = np.frombuffer(b"".join(contexts), np.uint8)
    data[np.repeat(base - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(joined))] = joined
    words = _words(data)
    # The sample: places of the grid within a context, by the bytes that follow.
    first, last = -(-base // GRID), (base + size) // GRID
    count = np.maximum(last - first, 0)
    owner = np.repeat(np.arange(len(size)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    rank = {GRID: np.full(len(data) // GRID + 8, -1, np.int64)}
    rank[GRID][place] = _named(*(words[place * GRID + j] for j in range(0, GRID, 8)))
    for whole, one, two in ((64, 32, 32), (128, 64, 64), (RANKED, 128, 32)):
        there = place[(rank[one][place] >= 0) & (rank[two][place + one // GRID] >= 0)]
        rank[whole] = np.full(len(rank[GRID]), -1, np.int64)
        rank[whole][there] = _named(rank[one][there], rank[two][there + one // GRID])
    # A class holds the sample places of a bucket that agree in rank and in their distance to the anchor.
    ranked = rank[RANKED][place] >= 0
    there, whose = place[ranked], owner[ranked]
    distance = there - (base + left)[whose] // GRID
    kind = np.full(len(rank[GRID]), -1, np.int64)
    kind[there] = _named(bucket[whose], distance, rank[RANKED][there])
    often = np.bincount(kind[there]) if len(there) else np.zeros(1, np.int64)
    # Windows, of which only those are sorted whose sample place has company.
    windows = size - window + 1
    whose = np.repeat(np.arange(len(size)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[whose] + start
    before = (-at) % GRID
    group = kind[(at + before) // GRID]
    some = np.flatnonzero(often[group] > 1)
    whose, start, at, before, group = (x[some] for x in (whose, start, at, before, group))
    after = at + before + RANKED
    keys = [group, before, *_head(words, at, before, GRID), *_head(words, after, window - RANKED - before, window - RANKED)]
    order = np.lexsort(keys[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    repeated = np.zeros(len(order), bool)
    repeated[order[1:]] |= same
    repeated[order[:-1]] |= same
    return whose[repeated], start[repeated]


def _runs(whose: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each context that adjoin, as contexts, first bytes and ends."""
    order = np.lexsort((start, whose))
    whose, start = whose[order], start[order]
    new = np.ones(len(whose), bool)
    new[1:] = (whose[1:] != whose[:-1]) | (start[1:] != start[:-1] + 1)
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(whose)) - 1
    return (whose[low], start[low], start[high] + window) if len(low) else (whose, start, start)


def _sorted_buckets(contexts: DataFrame, s: Settings, kind: str) -> DataFrame:
    """Repeated runs of contexts that occur once, from buckets sorted in groups."""
    n_bytes = contexts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = max(1, -(-int(n_bytes) // s.group_bytes))

    def run(table: pa.Table) -> pa.Table:
        whose, start = repeated_windows(
            table["bytes"].to_pylist(), table["left"].to_numpy().astype(np.int64), table["gram"].to_numpy(), s.window
        )
        once = table["n"].to_numpy() == 1
        whose, low, high = _runs(whose[once[whose]], start[once[whose]], s.window)
        rows = table.take(pa.array(whose))
        first = rows["start"].to_numpy()
        return pa.Table.from_arrays(
            [rows["id"], rows["same"], pa.array(first + low), pa.array(first + high)], names=["id", "same", "low", "high"]
        )

    grouped = contexts.withColumn("group", F.pmod(F.xxhash64("gram"), F.lit(groups))).groupBy("group")
    return grouped.applyInArrow(run, f"id {kind}, same long, low long, high long")


def _counted_buckets(contexts: DataFrame, s: Settings, kind: str) -> DataFrame:
    """The same for buckets too large to gather: windows are counted by their place and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, 0, 1 << 17)):
            out = [[] for _ in range(4)]
            for i, (data, left) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                array = np.frombuffer(data, np.uint8)
                n = len(array) - s.window + 1
                both = (anchors.Sums(array, b).hashes(slice(0, n), slice(s.window, s.window + n)) for b in anchors.BASES)
                for held, x in zip(out, (np.full(n, i), np.arange(n), *(h.view(np.int64) for h in both)), strict=True):
                    held.append(x)
            row, start, one, two = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            rows = batch.take(pa.array(row))
            place = rows.column(1).to_numpy() - start
            first = rows.column(6).to_numpy() + start
            columns = [rows.column(2), rows.column(3), rows.column(4), rows.column(5), pa.array(first)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(place), pa.array(one), pa.array(two)],
                names=["gram", "n", "id", "same", "low", "place", "one", "two"],
            )

    windows = contexts.select("bytes", "left", "gram", "n", "id", "same", "start").mapInArrow(
        run, f"gram long, n long, id {kind}, same long, low long, place long, one long, two long"
    )
    key = ["gram", "place", "one", "two"]
    often = windows.groupBy(*key).agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    return windows.filter("n = 1").join(often, key).select("id", "same", "low", (F.col("low") + s.window).alias("high"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """``id``, ``same`` and spans ``low``, ``high`` of repeated windows; spans may overlap and repeat."""
    s = settings or Settings()
    texts = _texts(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    found = stored(_repeated_anchors(texts, s), "anchors")
    key = ["gram", "context", "left", "size"]
    one_each = stored(
        found.groupBy(*key).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("id", "same", "start"))), "contexts"
    )
    full = found.join(one_each.filter("n > 1").select(*key), key).select(
        "id", "same", F.col("start").alias("low"), (F.col("start") + F.col("size")).alias("high")
    )
    # Buckets of several contexts, of which one occurs once.
    buckets = one_each.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("n").alias("fewest")).filter(
        "contexts > 1 AND fewest = 1"
    )
    open_ = stored(one_each.join(buckets.select("gram", "contexts"), "gram"), "open")
    bucket = F.pmod(F.xxhash64("id", "same"), F.lit(BUCKETS)).alias("of")
    near = texts.withColumn("of", bucket).join(F.broadcast(open_.select(bucket).distinct()), "of", "left_semi")
    some = near.dropDuplicates(["id", "same"]).select(F.col("id").alias("in_id"), F.col("same").alias("in_same"), "text")
    cut = F.substring("text", F.col("start").cast("int") + 1, F.col("size"))
    bytes_ = stored(
        open_.join(some, F.col("id").eqNullSafe(F.col("in_id")) & (F.col("same") == F.col("in_same")))
        .select(cut.alias("bytes"), "left", "size", "gram", "contexts", "n", "id", "same", "start"), "bytes",
    )
    small = F.col("contexts") <= s.bucket_contexts
    return full.unionByName(_sorted_buckets(bytes_.filter(small), s, kind)).unionByName(
        _counted_buckets(bytes_.filter(~small), s, kind)
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """Per row ``id``, ``n_bytes``, removed runs ``low`` and ``high``, and the bytes ``kept``."""
    texts = _texts(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    spans = repeated_spans(docs, id_col, text_col, settings).groupBy("id", "same").agg(
        F.collect_set(F.struct("low", "high")).alias("spans")  # equal rows have the same spans: each once
    )
    to = spans.select(
        F.col("id").alias("of_id"), F.col("same").alias("of_same"), F.col("spans.low").alias("lows"), F.col("spans.high").alias("highs")
    )
    joined = texts.join(to, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("same") == F.col("of_same")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, 0)):
            out = []
            for text, lows, highs in zip(*(batch.column(c).to_pylist() for c in ("text", "lows", "highs")), strict=True):
                runs: list[list[int]] = []
                for low, high in sorted(zip(lows or [], highs or [], strict=True)):
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], high)
                    else:
                        runs.append([low, high])
                ends = [0, *(x for run in runs for x in run), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append((len(text), [r[0] for r in runs], [r[1] for r in runs], kept))
            n, low, high, kept = zip(*out, strict=True) if out else ((),) * 4
            places = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(low, places), pa.array(high, places), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "low", "high", "kept"],
            )

    return joined.select("text", "id", "lows", "highs").mapInArrow(
        run, f"id {kind}, n_bytes long, low array<long>, high array<long>, kept binary"
    )
