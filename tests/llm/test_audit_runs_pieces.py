"""Filter audit, periodic runs and piece encoding against brute force, a plain walk and the library."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, periodic_runs, pieces

SPACE = re.compile("[ \t-\r]+")
library = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    r = random.Random(11)
    some = lambda n, k=9: " ".join(r.choice("the of Some WORDS and, more é 漢字 x1 $".split()[:k]) for _ in range(n))
    rows = [(1, "a", None), (2, "a", ""), (2, "a", ""), (3, None, " \t\n"), (4, "a", "one"), (None, "b", "one"), (None, None, some(70)), (5, "b", "one"), (5, "b", "one"), (6, "", "ONE")]
    rows += [(100 + k, r.choice(["a", "b", None, "c"]), some(r.randint(0, 120))) for k in range(150)]
    rows += [(400 + k, r.choice(["a", "b"]), rows[20 + k % 7][2]) for k in range(40)]
    rows += [(600, "a", "x " * 30 + "y"), (601, "a", ("p q " * 7 + "z ") * 6), (602, "d", "\x00é " * 9 + "  a"), (603, "d", some(15000)), (604, "d", "abc " * 20000), (605, "d", "abc " * 20000), (606, "e", "nospace" * 20000), (-7, "e", "#" * 40 + " 1 2 3 " * 40)]
    d = pd.DataFrame(rows, columns=["doc_id", "source", "text"]).astype({"doc_id": "Int64"})
    folder = tmp_path_factory.mktemp("awkward")
    for name in ("ids", "runs", "words", "n", "part", "mask", "good", "toxic", "digest", "collapsed", "decoded", "__runs", "__key", "__found", "best"):
        d[name] = "x"
    schema = pa.schema([(c, pa.int64() if c == "doc_id" else pa.string()) for c in d.columns])
    pq.write_table(pa.Table.from_pandas(d, schema, preserve_index=False), folder / "documents.parquet")
    labels = [(100 + k, k % 3, k % 2) for k in range(120)] + [(100, 1, 1), (None, 1, 1), (4, None, 1), (5, 1, None)]
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), folder / "labels.parquet")
    return str(folder), d[["doc_id", "source", "text"]], labels


def test_audit_against_applying_filters(spark, world):
    folder, docs, labels = world
    least = {}
    for i, t in zip(docs.doc_id, docs.text):
        if not pd.isna(i):
            least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, s, t in docs.itertuples(index=False):
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": not pd.isna(i) and least[t] < i}
        mine = [x for x in labels if not pd.isna(i) and x[0] == i]
        rows.append((s or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    expected, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                went = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                fail = [r for r in rows if r[0] == part and r[1][f]]
                expected[part, "".join(order), k + 1] = [len(left), len(went), len(fail) - len(went), sum(sum(r[1].values()) == 1 for r in fail), sum(r[2] for r in went), sum(r[3] for r in went)]
                total[part, f] = total.get((part, f), 0) + len(went)
    out = filter_audit.op11_filter_audit(spark, folder).collect()
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in out}
    assert len(got) == len(out) and got == {k: [*v, total[k[0], k[1][k[2] - 1]]] for k, v in expected.items()}


def test_audit_without_repeats_and_with_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (None, None, None)], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = filter_audit.audit(filter_audit.failed_masks(docs, labels, {"X": F.col("text") == "x", "Y": F.col("text") != "x"}, None), "XY")
    assert {tuple(r)[:5] for r in out.collect()} == {("", "XY", 1, 1, 0), ("", "XY", 2, 1, 0), ("", "YX", 1, 1, 0), ("", "YX", 2, 1, 0), ("a", "XY", 1, 1, 1), ("a", "XY", 2, 0, 1), ("a", "YX", 1, 1, 1), ("a", "YX", 2, 0, 1)}


def test_survivors_against_sums():
    r = np.random.default_rng(1)
    counts = r.integers(0, 9, (3, 2, 64))
    alive = filter_audit.survivors(counts)
    for s in range(64):
        assert (alive[..., s] == counts[..., [m for m in range(64) if not m & s]].sum(-1)).all()


def runs_of(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(6, 4 * q) and next(p for p in range(1, q + 1) if w[s : s + size - p] == w[s + p : s + size]) == q:
                out.append((s, size, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_scan_against_every_place():
    r = random.Random(4)
    for k in range(1500):
        w = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 80))]
        if k % 2 and len(w) > 8:
            p, s = r.randint(1, len(w) // 4), r.randrange(len(w))
            w = [x if i < s else w[s + (i - s) % p] for i, x in enumerate(w)]
        a = np.array(w, np.int32)
        assert sorted(periodic_runs.scan(a), key=lambda x: (x[0], x[2])) == runs_of(w)
        parts = periodic_runs.ranges(len(w), places=9)
        assert sorted((x for low, high in parts for x in periodic_runs.scan(a, low, high)), key=lambda x: (x[0], x[2])) == runs_of(w)


@pytest.mark.parametrize("length", [200_000])
def test_scan_of_long_texts_is_quick(length):
    for w in (np.zeros(length, np.int32), np.arange(length, dtype=np.int32) // 6, np.arange(length, dtype=np.int32) % 7):
        assert periodic_runs.scan(w)


def test_runs_against_brute_force(spark, world):
    folder, docs, _ = world
    out = {(None if pd.isna(r.doc_id) else r.doc_id, r.runs_sha256, r.collapsed_sha256): r for r in periodic_runs.op12_periodic_runs(spark, folder).collect()}
    seen = 0
    for i, text in zip(docs.doc_id, docs.text):
        w, i = words(text), None if pd.isna(i) else int(i)
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
            seen += 1
        if len(w) > 9000:
            runs = [(0, len(w), 1)] if len(set(w)) == 1 else sorted(periodic_runs.scan(np.unique(w, return_inverse=True)[1]), key=lambda x: (x[0], x[2]))
        else:
            runs = runs_of(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        r = out[i, sha("".join("%d,%d,%d\n" % x for x in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None, None, None)) and r.exponent_milli == (1000 * best[1] // best[2] if best else None)
    assert seen > 5


def test_long_documents_are_dealt_alike(spark, world):
    docs = spark.read.parquet(f"{world[0]}/documents.parquet").filter("doc_id <> 604 OR doc_id IS NULL")
    told = lambda df: sorted((r.doc_id or -1, r.text or "", str(r.runs), r["__key"]) for r in df.collect())
    near, far = periodic_runs.periodic_runs(docs, long_bytes=1 << 30), periodic_runs.periodic_runs(docs, long_bytes=20, places=50)
    assert told(near) == told(far) and far.columns == [*[c for c in docs.columns if c != "runs"], "runs"]


@pytest.fixture(scope="module")
def model():
    path = tokenizers.path("piece_bpe_32k.model")
    return pieces.PieceModel.load(path), library.SentencePieceProcessor(model_file=path)


def test_encoding_against_the_library(model):
    look, lib = pieces.tables(model[0]), model[1]
    r = random.Random(2)
    bits = [" ", "  ", "a", "b", "e", "n", "t", "th", "in", "\n", "\t", "é", "漢", "字", "的", "\U0001f600", "1", "23", "▁", ".", "-", "=", "A", "\x00", "́", "ни", " " * 33, "==" * 20, "the", "ing", "ana", "<s>", "<0x0A>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 50))) for _ in range(4000)]
    texts += [" " * k for k in range(70)] + ["x" + " " * k + "the" for k in range(70)] + ["a" * k for k in range(120)] + ["".join(r.choice("abanthe") for _ in range(150)) for _ in range(500)]
    ids, at = look.encode(*pieces.bytes_of(pa.array(texts)))
    wanted = lib.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == wanted
    out, begin = look.decode(ids, at)
    assert [out[a:b].decode() for a, b in zip(begin, begin[1:])] == lib.decode(wanted)


def test_decoding_of_any_ids_against_the_library(model):
    look, lib = pieces.tables(model[0]), model[1]
    r = random.Random(3)
    some = [[r.choice([r.randrange(32000), r.randrange(3, 259), 1, 2, 0, 259, 28705]) for _ in range(r.randint(0, 12))] for _ in range(3000)]
    out, begin = look.decode(np.array([x for s in some for x in s], np.int32), np.cumsum([0, *map(len, some)]))
    assert [out[a:b].decode() for a, b in zip(begin, begin[1:])] == [lib.decode(s) for s in some]


def test_blocks_and_words_of_one_hash(model, monkeypatch):
    look, lib = pieces.tables(model[0]), model[1]
    texts = ["the cat sat on the mat " * 40, "", "naïve 漢字 the cats"]
    monkeypatch.setattr(pieces, "BLOCK", 64)
    monkeypatch.setattr(look, "hashes", look.hashes & np.uint64(1))
    ids, at = look.encode(*pieces.bytes_of(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == lib.encode(texts)


def test_bytes_that_are_no_text(model):
    look, lib = pieces.tables(model[0]), model[1]
    raw = [b"ab\xff\xfe c", b"", b"\xe6\xbc", b"fine"]
    ids, at = look.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [lib.encode(x) for x in raw]


def test_pieces_query_against_the_library(spark, world, model):
    lib, docs = model[1], world[1]
    expected = sorted((-1 if pd.isna(i) else i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for i, t in zip(docs.doc_id, docs.text) for ids in [lib.encode(t or "")])
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in pieces.op13_sentencepiece(spark, world[0]).collect()) == expected
    docs = spark.read.parquet(f"{world[0]}/documents.parquet")
    made = pieces.encode(docs, model[0])
    assert sorted(made.columns) == sorted(docs.columns) and made.filter("size(ids) > 0").count()
