"""Removal of passages that repeat across documents, by suffix arrays over shards of the corpus.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Texts that are
equal as a whole are settled by their digest. For the others:

1. Every window of ``LENGTH`` bytes has an anchor, the least hash of the ``ANCHOR``-byte strings in it; windows that
   are equal have equal anchors. Runs of windows with one anchor make a segment. Hashes of all anchors are dealt by
   hash, and those of two documents at least are sent back.
2. Segments with such anchors are dealt by anchor, so that equal windows meet in a shard. A segment's bytes are sent
   once for each part of the corpus, for the least id there; the others there repeat it whole.
3. Each shard builds the suffix array of its segments' distinct texts by induced sorting, and the permuted common
   prefixes; suffixes next to each other that share ``LENGTH`` bytes are one string, and all but those with the least
   id are repeats.
4. The repeats are dealt back to the documents and merged.

Work is dealt by hashes of content or of ids, in parts of a fixed number of bytes, so no part grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, cut, small_batches
from .suffix_array import permuted_common_prefixes, suffix_array

LENGTH, ANCHOR = 50, 24
#: Bytes of text that a part of the corpus, and a shard, stand for.
PART_BYTES = 4 << 20
#: Rows that may be broadcast to pick out documents, at 16 bytes each; more are joined by shuffle.
BROADCAST_ROWS = 500_000
WINDOWS = 1 << 18
NO_ID = (1 << 63) - 1
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _hashes(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """A hash of the ANCHOR bytes at each place from begin to end."""
    wide = lambda k: np.ndarray((end - begin,), "<u8", data, begin + k, (1,))
    h = wide(0) * _K[0] + wide(8) * _K[1]
    h ^= h >> np.uint64(31)
    h += wide(16) * _K[2]
    h ^= h >> np.uint64(32)
    h *= _K[3]
    h ^= h >> np.uint64(29)
    return h


def anchor_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows within a row that have one anchor: first window, one past the last, the anchor's hash.

    Long runs may come in several pieces. Rows shorter than a window have none.
    """
    n, out = len(data), []
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
    size = np.diff(starts)
    step = np.zeros(n + 1, np.int32)
    long = size >= LENGTH
    np.add.at(step, starts[:-1][long], 1)
    np.add.at(step, starts[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    first = np.zeros(n, bool)
    first[starts[:-1][long]] = True
    span = LENGTH - ANCHOR + 1
    for p in range(0, n - LENGTH + 1, WINDOWS):
        q = min(n - LENGTH + 1, p + WINDOWS)
        h = _hashes(padded, p, q + span - 1)
        width = 1
        while width * 2 <= span:
            h = np.minimum(h[: len(h) - width], h[width:])
            width *= 2
        h = np.minimum(h[: q - p], h[span - width : span - width + q - p])
        ok = valid[p:q]
        new = ok.copy()
        new[1:] &= (h[1:] != h[:-1]) | ~ok[:-1] | first[p + 1 : q]
        begin = np.flatnonzero(new)
        if not len(begin):
            continue
        stop = ok.copy()
        stop[:-1] &= new[1:] | ~ok[1:]
        out.append((begin + p, np.flatnonzero(stop) + 1 + p, h[begin]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pack(h: np.ndarray) -> bytes:
    """The high 48 bits; a chance agreement only makes a segment a candidate that it need not be."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _bucket(h: np.ndarray, parts: int) -> np.ndarray:
    """By the hash's middle bits: its high ones are low, as anchors are the least of many."""
    return ((h >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)


def _deal_anchors(parts: int):
    """Rows (part, text) to rows (bucket, hashes, parts): each anchor of a document, at most twice for each part and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy(zero_copy_only=False)
            data, starts = bytes_of(batch.column(1))
            begin, _, h = anchor_runs(data, starts)
            row = np.searchsorted(starts, begin, side="right") - 1
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            keep = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
            h, where = h[keep], part[row[keep]]
            order = np.lexsort((where, h))
            h, where = h[order], where[order]
            keep = np.ones(len(h), bool)
            keep[2:] = (h[2:] != h[:-2]) | (where[2:] != where[:-2])
            h, where = h[keep], where[keep].astype(np.uint32)
            bucket = _bucket(h, parts)
            order = np.argsort(bucket, kind="stable")
            h, where, bucket = h[order], where[order], bucket[order]
            edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(h)]), len(h))
            rows = [(int(bucket[a]), _pack(h[a:b]), where[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "hashes", "parts"])

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket, the anchors of two documents at least, by part."""
    h = np.concatenate([_unpack(x.as_py()) for x in table.column("hashes")])
    where = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("parts")])
    order = np.argsort(h, kind="stable")
    h, where = h[order], where[order]
    equal = h[1:] == h[:-1]
    shared = np.append(equal, False) | np.append(False, equal)
    h, where = h[shared], where[shared]
    order = np.argsort(where, kind="stable")
    h, where = h[order], where[order]
    edge = np.append(np.flatnonzero(np.append(True, where[1:] != where[:-1])[: len(h)]), len(h))
    rows = [(int(where[a]), _pack(np.unique(h[a:b]))) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "hashes": pa.array([r[1] for r in rows], pa.binary())})


#: A segment or a repeat: the document's key and id, and where in the document it starts and ends.
SPAN = np.dtype([("key", "<i8"), ("id", "<i8"), ("start", "<i8"), ("end", "<i8")])
_SEGMENTS = pa.schema([("shard", pa.int64()), ("spans", pa.binary()), ("text", pa.binary()), ("repeats", pa.bool_())])


def _segments(parts: int):
    """One part's documents (part, key, id, text) and shared anchors to rows by shard: segments with their bytes, or repeats."""

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        if not len(docs) or not len(anchors):
            return _SEGMENTS.empty_table()
        wanted = np.unique(np.concatenate([_unpack(x.as_py()) for x in anchors.column("hashes")]))
        data, starts = bytes_of(docs.column("text"))
        keys, ids = docs.column("key").to_numpy(), docs.column("id").to_numpy()
        begin, end, h = anchor_runs(data, starts)
        cut48 = h & ~np.uint64(0xFFFF)
        at = np.minimum(np.searchsorted(wanted, cut48), len(wanted) - 1)
        hit = wanted[at] == cut48
        begin, end, h = begin[hit], end[hit] + LENGTH - 1, h[hit]
        row = np.searchsorted(starts, begin, side="right") - 1
        shard = _bucket(h, parts)
        # the least id first, so that a text's first segment is the one to send
        order = np.lexsort((begin, ids[row], shard))
        spans = np.zeros(len(order), SPAN)
        spans["key"], spans["id"] = keys[row[order]], ids[row[order]]
        spans["start"], spans["end"] = begin[order] - starts[row[order]], end[order] - starts[row[order]]
        begin, end, shard = begin[order].tolist(), end[order].tolist(), shard[order]
        whole = data.tobytes()
        rows, edge = [], np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)]), len(shard))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            least: dict[bytes, int] = {}
            send, repeat, texts = [], [], []
            for k in range(a, b):
                text = whole[begin[k] : end[k]]
                owner = least.setdefault(text, spans["id"][k])
                if spans["id"][k] > owner:
                    repeat.append(k)
                else:
                    send.append(k)
                    texts.append(text)
            rows.append((int(shard[a]), spans[send].tobytes(), b"".join(texts), False))
            if repeat:
                rows.append((int(shard[a]), spans[repeat].tobytes(), b"", True))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SEGMENTS)], schema=_SEGMENTS)

    return run


def _anchors_of(texts: list[bytes]) -> np.ndarray:
    """The anchor of each segment: the least hash in it."""
    data = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    h = _hashes(data, 0, int(starts[-1]))
    inside = np.ones(len(h), bool)
    for k in range(1, ANCHOR):
        inside[starts[1:] - k] = False
    h[~inside] = np.uint64((1 << 64) - 1)
    return np.minimum.reduceat(h, starts[:-1])


def repeats_in_shard(spans: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Of segments (SPAN and bytes), the spans whose every window also starts in a document with a smaller id."""
    owners: dict[bytes, list[int]] = {}
    for k, t in enumerate(texts):
        owners.setdefault(t, []).append(k)
    distinct = list(owners)
    least = np.array([min(int(spans["id"][k]) for k in owners[t]) for t in distinct], np.int64)
    out = [spans[k] for t, i in zip(distinct, least.tolist(), strict=True) for k in owners[t] if spans["id"][k] > i]
    # an anchor that a single text has needs no suffix array: its windows are in no other text
    _, anchor, many = np.unique(_anchors_of(distinct), return_inverse=True, return_counts=True) if distinct else (None, np.zeros(0, int), np.zeros(0, int))
    several = np.flatnonzero(many[anchor] > 1) if len(distinct) else np.zeros(0, int)
    if len(several):
        some = [distinct[k] for k in several]
        size = np.array([len(t) for t in some])
        # a separator, 1, stands after each text and 0 at the end; bytes are two more
        starts = np.cumsum([0, *(size + 1)])
        data = np.frombuffer(b"\0".join(some) + b"\0", np.uint8)
        symbols = data.astype(np.int64) + 2
        symbols[starts[1:] - 1] = 1
        sa = suffix_array(np.append(symbols, 0))[1:]
        padded = np.concatenate([data, np.zeros(LENGTH + 16, np.uint8)])
        common = permuted_common_prefixes(padded, sa, LENGTH)
        text_of = np.repeat(np.arange(len(some)), size + 1)
        rest = starts[text_of + 1] - 1 - np.arange(len(data))
        window = rest[sa] >= LENGTH
        place = sa[window]
        # windows next to each other are one string if they share LENGTH bytes; a suffix between two such is a window itself
        new = np.append(True, (common[place[1:]] < LENGTH) | (np.flatnonzero(window)[1:] != np.flatnonzero(window)[:-1] + 1))
        group = np.cumsum(new) - 1
        lowest = np.minimum.reduceat(least[several][text_of[place]], np.flatnonzero(new))
        low = np.full(len(data), NO_ID, np.int64)
        low[place] = lowest[group]
        for k, t in enumerate(some):
            span = low[starts[k] : starts[k] + size[k] - LENGTH + 1]
            for o in owners[t]:
                if spans["id"][o] > least[several[k]]:
                    continue  # told as a whole
                covered = span < spans["id"][o]
                if covered.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        begin = int(spans["start"][o])
                        out.append(np.array((spans["key"][o], spans["id"][o], begin + a, begin + b - 1 + LENGTH), SPAN))
    return np.array(out, SPAN)


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * _K[0]
    return ((x >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _find_repeats(parts: int):
    def run(table: pa.Table) -> pa.Table:
        spans, texts, found = [], [], []
        for row in table.to_pylist():
            here = np.frombuffer(row["spans"], SPAN)
            if row["repeats"]:
                found.append(here)
                continue
            spans.append(here)
            edge = np.cumsum([0, *(here["end"] - here["start"])]).tolist()
            texts += [row["text"][a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        if spans:
            found.append(repeats_in_shard(np.concatenate(spans), texts))
        every = np.concatenate(found) if found else np.zeros(0, SPAN)
        where = _part(every["key"], parts)
        order = np.lexsort((every["start"], every["key"], where))
        every, where = every[order], where[order]
        edge = np.append(np.flatnonzero(np.append(True, where[1:] != where[:-1])[: len(where)]), len(where))
        rows = [(int(where[a]), every[["key", "start", "end"]][a:b].astype(_RANGE).tobytes(), np.unique(every["key"][a:b]).tolist()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "ranges": pa.array([r[1] for r in rows], pa.binary()), "keys": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})

    return run


_RANGE = np.dtype([("key", "<i8"), ("start", "<i8"), ("end", "<i8")])


def keep_rest(text: bytes, ranges: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs removed, and the bytes that are left."""
    order = np.argsort(ranges["start"], kind="stable")
    removed, spans, kept, at = 0, 0, [], 0
    for start, end in zip(ranges["start"][order].tolist(), ranges["end"][order].tolist(), strict=True):
        if start > at or not spans:
            kept.append(text[at:start])
            spans += 1
            removed += end - start
            at = end
        elif end > at:
            removed += end - at
            at = end
    kept.append(text[at:])
    return removed, spans, b"".join(kept)


def _finish(docs: pa.Table, ranges: pa.Table) -> pa.Table:
    if len(docs) and len(ranges):
        every = np.concatenate([np.frombuffer(x.as_py(), _RANGE) for x in ranges.column("ranges")])
        every = every[np.argsort(every["key"], kind="stable")]
    else:
        every = np.zeros(0, _RANGE)
    keys, out = docs.column("key").to_numpy() if len(docs) else np.zeros(0, np.int64), []
    low, high = np.searchsorted(every["key"], keys, "left"), np.searchsorted(every["key"], keys, "right")
    for key, a, b, text in zip(keys.tolist(), low, high, docs.column("text") if len(docs) else [], strict=True):
        if b > a:
            removed, spans, kept = keep_rest((text.as_py() or "").encode(), every[a:b])
            out.append((key, removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
    names = [("key", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
    return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(names)})


class RepeatRemoval:
    """Finds the repeats of ``docs``; ``result()`` has a row a document: id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. A null id is above every other, so of two rows with null ids neither is removed for the
    other; rows that repeat an id do not count for each other either. ``kept_texts()`` gives what is left of the
    documents that lose a part, as text (a character that is cut in two becomes U+FFFD there; digests are of the bytes).
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        docs = docs.select(F.col(id_col).cast("long").alias("true_id"), text.alias("text"))
        self.docs = docs.select("true_id", F.coalesce("true_id", F.lit(NO_ID)).alias("id"), F.xxhash64(F.col("true_id"), F.col("text")).alias("key"), "text")
        self.part_bytes = part_bytes

    def _pick(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "key", how)

    def run(self) -> RepeatRemoval:
        self.rows = cut(self.docs.select("true_id", "id", "key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "repeat-rows")
        first = self.rows.groupBy("digest").agg(F.min("id").alias("first"))
        self.rows = cut(self.rows.join(first, "digest"), "repeat-rows")
        copies = cut(self.rows.filter("id > first").select("key").distinct(), "repeat-copies")
        total = self.rows.filter("id = first").agg(F.sum("n_bytes")).first()[0] or 0
        parts = max(1, -(-total // self.part_bytes))
        part = F.pmod(F.shiftright(F.xxhash64("key"), 7), F.lit(parts)).alias("part")
        docs = self._pick(self.docs.filter(F.octet_length("text") >= LENGTH), copies, "left_anti").select(part, "key", "id", "text")
        dealt = docs.select("part", "text").mapInArrow(_deal_anchors(parts), "bucket long, hashes binary, parts binary")
        shared = dealt.groupBy("bucket").applyInArrow(_shared_anchors, "part long, hashes binary")
        segments = docs.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_segments(parts), "shard long, spans binary, text binary, repeats boolean")
        self.ranges = cut(segments.groupBy("shard").applyInArrow(_find_repeats(parts), "part long, ranges binary, keys array<long>"), "repeat-ranges")
        keys = cut(self.ranges.select(F.explode("keys").alias("key")).distinct(), "repeat-keys")
        touched = self._pick(self.docs, keys, "left_semi")
        n = parts

        def add_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_part(batch.column(0).to_numpy(zero_copy_only=False), n)), *batch.columns], names=["part", *batch.schema.names])

        placed = touched.select("key", "text").mapInArrow(add_part, "part long, key long, text string")
        self.found = placed.groupBy("part").cogroup(self.ranges.groupBy("part")).applyInArrow(_finish, "key long, n_removed long, n_spans long, kept_sha256 string, kept string")
        return self

    def kept_texts(self) -> DataFrame:
        return self.found.select("key", "kept")

    def result(self) -> DataFrame:
        # rows that repeat id and text have one key and one result
        found = self.found.drop("kept").distinct()
        out = self.rows.join(found, "key", "left")
        whole = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
        return out.select(
            F.col("true_id").alias("id"), "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = RepeatRemoval(spark.read.parquet(f"{sf_dir}/documents.parquet")).run()
    return found.result().withColumnRenamed("id", "doc_id")
