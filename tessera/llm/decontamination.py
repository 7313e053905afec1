"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

A random walk reads a string and writes the byte under its pointer at each step; whether the pointer then advances is
a coin of the step and the byte. Strings within a small edit distance so become strings within a small Hamming distance.
Bit sampling keeps a few of the written bytes as a key. Keys are taken of all windows of every benchmark item that start
at a word, and of the windows at every word of every document, by several walks; in long words (text written without
spaces, addresses, code), items have a window every few bytes and documents one at every character; equal keys make a candidate: an
item-sized window of the document, at the place where the item would start. The exact edit distance between the
candidate and the item decides.

The walk reads classes of bytes (31 in all), so that three steps are one look into a table, and one of
each three steps is sampled. The windows of a document are walked together, and those whose first sampled bytes are
those of no item are let go before the walk's end, which changes no key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import IS_SPACE, LOWER_BYTES, bytes_of, cut, discard, pieces, small_batches

#: Edits that a copy may have, as a share of the item's bytes.
MOST_EDITS = 0.2
#: By the bytes that an item has less than: steps of a walk, a third of which are sampled, walks, and after how many sampled bytes windows are let go.
PLANS = ((150, 33, 10, (3, 5, 7)), (float("inf"), 39, 6, (5, 7, 9)))
STEPS, SEED = max(p[1] for p in PLANS), 20260723
#: Bits of the tables by which windows are let go; so many sampled bytes have a place of their own in them.
SIEVE_BITS, EXACT = 18, 3
#: Classes of bytes: white space, the letters, and for other bytes any of thirty, those of letters among them.
CLASS = np.array([0 if c == 32 else c - 96 if 97 <= c <= 122 else 1 + c * 11 % 30 for c in range(256)], np.uint16)
#: The class of what lies beyond a window, which no byte has; pairs of windows and chunks that are compared at a time.
BEYOND, PAIRS = 31, 2048
#: Items that are searched for at once; more are searched for in blocks.
BLOCK = 20_000
WINDOWS, PIECE = 1 << 15, 1 << 20
#: A word of more bytes has windows inside it: at every character in a document, and in an item at one of so many bytes.
LONG_WORD, APART = 24, 6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalise(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased and each run of white space one space (none at a row's start), the rows' starts, and where words start."""
    space = IS_SPACE[data]
    before = np.ones(len(space), bool)
    before[1:] = space[:-1]
    first = starts[:-1][starts[:-1] < len(data)]
    before[first] = True
    keep = ~(space & before)
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    out, begins = np.where(space, 32, LOWER_BYTES[data]).astype(np.uint8)[keep], place[starts]
    word = (out != 32) & before[keep]
    return out, begins, np.flatnonzero(word)


def window_starts(text: np.ndarray, begins: np.ndarray, words: np.ndarray, apart: int = 1) -> np.ndarray:
    """Where windows start: at each word (``words``), and in long ones at each character that is ``apart`` or more bytes after the last such place."""
    following = np.append(words[1:], len(text))
    some = np.flatnonzero(following - words > LONG_WORD)
    first, end = words[some], following[some]
    end = np.minimum(end, begins[np.minimum(np.searchsorted(begins, first, side="right"), len(begins) - 1)])
    end = end - (text[end - 1] == 32)
    long = end - first > LONG_WORD
    if not long.any():
        return words
    first, end = first[long], end[long]
    steps = -(-(end - first) // apart)
    inner = np.repeat(first, steps) + apart * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps))
    # to the next byte that starts a character; a character has four bytes at most
    for _ in range(3):
        inner = inner + (((text[np.minimum(inner, len(text) - 1)] & 0xC0) == 0x80) & (inner < len(text)))
    inner = np.unique(inner[(inner < np.repeat(end, steps)) & (inner > np.repeat(first, steps))])
    return np.insert(words, np.searchsorted(words, inner), inner)


def plan_for(size: int) -> tuple[int, int, tuple[int, ...]]:
    """Steps, walks and sieves for an item of so many bytes; items shorter than a walk has steps have as many steps as threes fit in."""
    steps, walks, sieves = next(p for most, *p in PLANS if size < most)
    return min(steps, max(3, size // 3 * 3)), walks, sieves


@dataclass(frozen=True)
class Walk:
    tables: np.ndarray  # by three steps and the classes of three bytes: how far the pointer moves, plus four times the class sampled
    sieves: dict[int, np.ndarray]  # by number of sampled bytes: which hashes of them lead to a key
    keys: np.ndarray  # sorted
    item: np.ndarray  # of each key
    offset: np.ndarray  # of each key's window in the item


@dataclass(frozen=True)
class Index:
    items: tuple[bytes, ...]
    ids: tuple[int, ...]
    walks: tuple[Walk, ...]
    chunk: np.ndarray  # the first chunk of each item, and one more
    masks: np.ndarray  # of each chunk of 64 bytes (an item's last may have fewer), by class, which of its bytes have it
    last: np.ndarray  # of each chunk, the bit of its last byte


def _slot(code: np.ndarray, taken: int) -> np.ndarray:
    return code.astype(np.int64) if taken <= EXACT else ((code * _ODD) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def step_tables(coins: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """One table for each three steps. ``coins`` tells by step and class whether the pointer moves, ``sampled`` which of the three steps writes."""
    three = np.arange(1 << 15)
    out = np.zeros((len(sampled), 1 << 15), np.uint8)
    for k, which in enumerate(sampled):
        moved = np.zeros(1 << 15, np.int64)
        for r in range(3):
            here = (three >> (5 * moved)) & 31
            if r == which:
                out[k] += (here << 2).astype(np.uint8)
            moved += coins[3 * k + r][here]
        out[k] += moved.astype(np.uint8)
    return out


def in_threes(text: np.ndarray) -> np.ndarray:
    """The classes of the three bytes at each place but the last two, five bits each, as indexes."""
    c = CLASS[text]
    return (c[:-2] | c[1:-1] << np.uint16(5) | c[2:] << np.uint16(10)).astype(np.intp)


def run_walk(threes: np.ndarray, at: np.ndarray, tables: np.ndarray, sieves: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The windows (indexes into ``at``) that pass the sieves, and their keys, five bits a sampled class. ``threes`` must go on for a walk's steps."""
    p, which, code = at.copy(), np.arange(len(at)), np.zeros(len(at), np.uint64)
    for taken, table in enumerate(tables, 1):
        told = table.take(threes.take(p))
        p += told & 3
        code <<= np.uint64(5)
        code |= told >> 2
        if taken in sieves:
            stay = np.flatnonzero(sieves[taken].take(_slot(code, taken)))
            p, which, code = p.take(stay), which.take(stay), code.take(stay)
            if not len(p):
                break
    return which, code


def build_index(items: list[tuple[int, str]]) -> Index:
    """Keys of all items; an item of white space alone is left out, as is a null one."""
    kept = [(i, b) for i, t in items if t and (b := bytes(normalise(*bytes_of(pa.array([t])))[0]).strip())]
    texts, ids = tuple(b for _, b in kept), tuple(i for i, _ in kept)
    walks = []
    for plan in sorted({plan_for(len(b)) for b in texts}):
        steps, count, at_bytes = plan
        rng = np.random.default_rng([SEED, steps])
        here = [k for k, b in enumerate(texts) if plan_for(len(b)) == plan]
        threes = in_threes(np.frombuffer(b"".join(texts[k] for k in here) + bytes(steps + 3), np.uint8))
        begins = np.cumsum([0, *(len(texts[k]) for k in here)])
        item, at = [], []
        for n, k in enumerate(here):
            b = np.frombuffer(texts[k], np.uint8)
            offsets = window_starts(b, np.array([0, len(b)]), np.flatnonzero((b != 32) & np.r_[True, b[:-1] == 32]), APART)
            # a walk reads about half as many bytes as it has steps
            offsets = offsets[offsets <= max(0, len(b) - steps // 2)]
            item.append(np.full(len(offsets), k))
            at.append(offsets + begins[n])
        item, at = np.concatenate(item), np.concatenate(at)
        offset = at - begins[np.searchsorted(here, item)]
        for _ in range(count):
            tables = step_tables(rng.integers(0, 2, (steps, 32)), rng.integers(0, 3, steps // 3))
            sieves = {}
            for n in at_bytes:
                if n < len(tables):
                    sieves[n] = np.zeros(1 << (5 * n if n <= EXACT else SIEVE_BITS), bool)
                    sieves[n][_slot(run_walk(threes, at, tables[:n], {})[1], n)] = True
            keys = run_walk(threes, at, tables, {})[1]
            order = np.argsort(keys, kind="stable")
            walks.append(Walk(tables, sieves, keys[order], item[order], offset[order]))
    many = [-(-len(b) // 64) for b in texts]
    chunk = np.cumsum([0, *many])
    masks, last = np.zeros((chunk[-1], 32), np.uint64), np.zeros(chunk[-1], np.uint64)
    for k, b in enumerate(texts):
        for n in range(many[k]):
            part = CLASS[np.frombuffer(b[64 * n : 64 * n + 64], np.uint8)]
            np.bitwise_or.at(masks[chunk[k] + n], part, np.uint64(1) << np.arange(len(part), dtype=np.uint64))
            last[chunk[k] + n] = np.uint64(1) << np.uint64(len(part) - 1)
    return Index(texts, ids, tuple(walks), chunk, masks, last)


def chunk_distances(masks: np.ndarray, last: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each chunk the least edit distance between it and any substring of its window, both as classes, all chunks at once."""
    up = last | (last - np.uint64(1))
    down = np.zeros_like(up)
    score = np.bitwise_count(up).astype(np.int16)
    best, row, one = score.copy(), np.arange(len(masks)) * 32, np.uint64(1)
    flat = masks.reshape(-1)
    for c in windows.T:
        eq = flat.take(row + c)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up)
        mh = up & xh
        score += (ph & last) != 0
        score -= (mh & last) != 0
        ph <<= one
        mh <<= one
        up, down = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best)
    return best


def least_distances(index: Index, classes: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each candidate (an item, and where its window begins and ends) a bound that its edit distance cannot be below: the sum over the item's chunks of 64 bytes, as far as it stays within ``most``."""
    out = np.zeros(len(item), np.int64)
    many, n = index.chunk[item + 1] - index.chunk[item], 0
    # windows of about the same length go together
    left = np.argsort(end - begin, kind="stable")
    while len(left := left[(many[left] > n) & (out[left] <= most[left])]):
        for p in range(0, len(left), PAIRS):
            o = left[p : p + PAIRS]
            k = index.chunk[item[o]] + n
            at = begin[o][:, None] + np.arange(int((end - begin)[o].max()))
            windows = np.where(at < end[o][:, None], classes.take(np.minimum(at, len(classes) - 1)), BEYOND)
            out[o] += chunk_distances(index.masks[k], index.last[k], windows.astype(np.intp))
        n += 1
    return out


def edit_distance_within(item: bytes, text: bytes) -> int:
    """The least edit distance between ``item`` and any substring of ``text``, by bit-parallel dynamic programming.

    >>> edit_distance_within(b"kitten", b"a sitting cat")
    2
    """
    if item in text:
        return 0
    n = len(item)
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for c in text:
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best


def search(data: np.ndarray, starts: np.ndarray, index: Index, most_edits: float = MOST_EDITS) -> list[dict[int, int]]:
    """For each row the items that it holds (positions in the index) and their least edit distances."""
    text, begins, at = normalise(data, starts)
    at = window_starts(text, begins, at)
    padded = np.concatenate([text, np.zeros(STEPS + 3, np.uint8)])
    threes = in_threes(padded)
    found: set[tuple[int, int, int]] = set()
    for walk in index.walks:
        for p in range(0, len(at), WINDOWS):
            part = at[p : p + WINDOWS]
            which, keys = run_walk(threes, part, walk.tables, walk.sieves)
            if not len(which):
                continue
            low, high = np.searchsorted(walk.keys, keys, "left"), np.searchsorted(walk.keys, keys, "right")
            many = high - low
            if not many.any():
                continue
            window = np.repeat(part[which], many)
            hit = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row = np.searchsorted(begins, window, side="right") - 1
            found.update(zip(row.tolist(), walk.item[hit].tolist(), (window - walk.offset[hit]).tolist(), strict=True))
    out: list[dict[int, int]] = [{} for _ in range(len(starts) - 1)]
    candidates, joined, i = sorted(found), [], 0
    while i < len(candidates):  # places close together make one window
        row, item, low = candidates[i]
        size = len(index.items[item])
        slack, j, high = int(most_edits * size), i + 1, low
        while j < len(candidates) and candidates[j][:2] == (row, item) and candidates[j][2] <= high + size // 2:
            high, j = candidates[j][2], j + 1
        joined.append((row, item, max(int(begins[row]), low - slack), min(int(begins[row + 1]), high + size + slack), slack))
        i = j
    whole = bytes(text)
    for p in range(0, len(joined), PAIRS):
        part = np.array(joined[p : p + PAIRS], np.int64)
        least = least_distances(index, CLASS[text], part[:, 1], part[:, 2], part[:, 3], part[:, 4])
        for row, item, begin, end, slack in part[least <= part[:, 4]].tolist():
            distance = edit_distance_within(index.items[item], whole[begin:end])
            if distance <= slack:
                out[row][item] = min(distance, out[row].get(item, distance))
    return out


HITS = "__hits"
_HIT = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int64())]))


def _searcher(sent, text_col: str, drop_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            data, starts = bytes_of(batch.column(batch.schema.get_field_index(text_col)))
            hits = []
            for i, j in pieces(starts, PIECE):
                hits += search(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], index)
            before = batch.column(batch.num_columns - 1).to_pylist()
            now = [sorted([*(b or []), *({"item": index.ids[k], "distance": d} for k, d in h.items())], key=lambda x: (x["item"] is None, x["item"] or 0, x["distance"])) for b, h in zip(before, hits, strict=True)]
            kept = [k for k, n in enumerate(batch.schema.names[:-1]) if not (drop_text and n == text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(now, _HIT)], names=[batch.schema.names[k] for k in (*kept, -1)])

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_id: str = "item_id", item_col: str = "text", block: int = BLOCK, out_col: str = HITS) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``out_col`` added: the items that the whole text holds, with their edit distances, by item.

    Null and empty texts hold nothing; null or blank items are held by none; items that repeat are all told. Rows are
    independent and nothing is shuffled; an empty table gives no rows, and without items no row has hits. Columns of
    any name but ``out_col`` may be kept. The items are a query set: the driver reads them in blocks of ``block``, each
    of which goes over all documents before the next is read, so what is held and broadcast at once is bounded
    whatever the number of items.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns = [*keep, *([] if text_col in keep else [text_col])]
    df = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in columns], F.array().cast("array<struct<item:bigint,distance:bigint>>").alias(out_col))
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_col).cast("string").alias("t")).orderBy("i", "t").toLocalIterator()
    part, n = [(r.i, r.t) for _, r in zip(range(block), items, strict=False)], 0
    if not part:
        return df.select(*[F.col(f"`{c}`") for c in keep], out_col)
    while part:
        index, part = build_index(part), [(r.i, r.t) for _, r in zip(range(block), items, strict=False)]
        drop = not part and text_col not in keep
        schema = StructType([f for f in df.schema.fields if not (drop and f.name == text_col)])
        found = df.mapInArrow(_searcher(spark.sparkContext.broadcast(index), text_col, drop), schema)
        if part:  # a worker holds the index of one block at a time
            found = cut(found, "decontamination-block")
            discard(df)
        df = found
    return df.select(*[F.col(f"`{c}`") for c in keep], out_col)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, whether it is contaminated, how many items it holds, which, and the least edit distance (null for none)."""
    out = find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("__hits") > 0).alias("contaminated"), F.size("__hits").cast("long").alias("n_items"), F.col("__hits.item").alias("item_ids"), F.array_min("__hits.distance").alias("least_edits"))
