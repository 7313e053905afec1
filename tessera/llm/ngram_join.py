"""N-gram Jaccard join by a token-group matrix.

Documents are sets of hashed word n-grams; documents with equal sets are one from the start. Then:

1. Similar sets are put into groups: sets that share a minimum under one of a few hash functions and whose sketches
   look alike are one group with the least of them. Groups need not be linked; the result does not depend on them.
2. The token-group matrix holds, for each token and group, what the group's union of tokens says about the overlap that
   a query can reach: the sizes of the members that have the token, and the most tokens that any of them has from this
   one on. A set's tokens are ordered, those that many documents share last, and only as many of the first are entered
   as linked sets must share one of.
3. For every two groups that share a token, the matrix bounds the overlap of their members; of two single sets,
   outlines (counts of tokens in buckets) bound it more closely. Only groups that could reach the threshold are opened:
   the members of the smaller are queries against all members of the larger.

Groups are held in blocks of bounded size, and a task compares two blocks: it counts the common tokens of each member
of one with all members of the other and returns a row a member, with its links and the least set that the block's
links connect it to. So no pair becomes a row, and what is written grows with the members, not with the pairs. Every
comparison is exact, on the whole sets, and no pair that could be linked is left out: linked sets are in one group, or
share a first common token among those entered, and the bound at this token cannot be below their overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, bytes_of, cut, discard, free_name, mix, pieces, small_batches, word_bounds
from .components import connected_components

PIECE = 1 << 20
#: Hash functions for grouping, bins of a sketch, and the share of equal bins from which sets are put into one group.
MINIMA, BINS, ALIKE = 3, 16, 0.35
#: A token is common if, over the blocks in which more than two sets share it, so large a share of all documents and so many have it.
COMMON_SHARE, COMMON_LEAST = 1 / 20000, 8
#: Tokens of a block that are counted together, 8 bytes each.
BLOCK_TOKENS = 4_000_000
#: Bytes of tokens in a block of a group: the least and the most that blocks are made for, and how many blocks a group has before they grow.
LEAST_BLOCK, MOST_BLOCK, FEW_BLOCKS = 1 << 20, 16 << 20, 8
#: Buckets of a set's outline, and the most that one can count.
OUTLINE, MOST_COUNT = 256, 65535
#: Rows of identifiers that may be broadcast, at some 60 bytes each; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(20260723)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


def hash_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER_BYTES[data]] * _powers(_POWER, len(data)), out=sums[1:])
    return mix((sums[end] - sums[begin]) * _powers(_INVERSE, len(data) + 1)[begin])


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; fewer words make one, none make none."""
    data, starts = bytes_of(column)
    out: list[np.ndarray] = []
    for i, j in pieces(starts, PIECE):
        part = data[starts[i] : starts[j]]
        begin, end, many = word_bounds(part, starts[i : j + 1] - starts[i])
        if not len(begin):
            out += [np.zeros(0, np.uint64)] * (j - i)
            continue
        h = hash_words(part, begin, end)
        whole = max(0, len(h) - words + 1)
        gram = np.zeros(whole, np.uint64)
        for k in range(words):
            gram += h[k : k + whole] * _ODD[k]
        gram = mix(gram)
        at = np.cumsum([0, *many])
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(gram[a : b - words + 1]))
            elif b > a:
                short = np.uint64(int(b - a) * int(_ODD[63]) & _MASK)
                out.append(mix((h[a:b] * _ODD[: b - a]).sum(keepdims=True, dtype=np.uint64) + short))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _key(tokens: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    x = int(mix(tokens * _ODD[40]).sum(dtype=np.uint64)) + len(tokens) * int(_ODD[41])
    return int(mix(np.array([x & _MASK], np.uint64)).view(np.int64)[0])


def outline(tokens: np.ndarray) -> bytes:
    """How many of a set's tokens fall into each of OUTLINE buckets, as 16-bit numbers."""
    return np.minimum(np.bincount((tokens >> np.uint64(40)).astype(np.int64) % OUTLINE, minlength=OUTLINE), MOST_COUNT).astype(np.uint16).tobytes()


def prefix_size(n: int, t: Fraction) -> int:
    """How many first tokens a set enters: of so many, sets linked to it have one."""
    return n - -(-n * t.numerator // t.denominator) + 1


def _common_tokens(words: int):
    """Tokens that several sets share, counted over all rows in blocks of about BLOCK_TOKENS tokens; one more row a block carries its number of rows."""

    def told(held: list[np.ndarray], rows: int) -> pa.RecordBatch:
        token, many = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        shared = many > 2
        return pa.RecordBatch.from_arrays([pa.array(np.r_[token[shared].view(np.int64), 0]), pa.array(np.r_[many[shared], 0]), pa.array(np.r_[np.zeros(shared.sum(), np.int64), rows])], names=["token", "many", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, rows, size = [], set(), 0, 0
        for batch in batches:
            rows += len(batch)
            for s in shingle_sets(batch.column(0), words):
                # sets that are equal would make all their tokens look common
                if len(s) and (key := _key(s)) not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
            if size > BLOCK_TOKENS:
                yield told(held, rows)
                held, seen, rows, size = [], set(), 0, 0
        yield told(held, rows)

    return run


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The first token in each of BINS equal ranges, cut to 32 bits; 0 for a range without tokens."""
    edges = np.arange(BINS, dtype=np.uint64) * np.uint64((1 << 64) // BINS)
    at = np.searchsorted(tokens, edges)
    some = at < np.r_[at[1:], len(tokens)]
    out = np.zeros(BINS, np.uint64)
    out[some] = tokens[at[some]] >> np.uint64(20)
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _sets(words: int, t: Fraction, sent):
    odd = _ODD[44 : 44 + MINIMA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, weight = sent.value
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            keys, checks, sizes, firsts, minima, sketches, outlines = [], [], [], [], [], [], []
            for s in sets:
                keys.append(_key(s))
                checks.append(int(s.sum(keepdims=True, dtype=np.uint64).view(np.int64)[0]))
                outlines.append(outline(s))
                sizes.append(len(s))
                if not len(s):
                    firsts.append([])
                    minima.append([])
                    sketches.append([])
                    continue
                order = s
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    order = s[np.lexsort((s, np.where(common[at] == s, weight[at], 0)))]
                firsts.append(order[: prefix_size(len(s), t)].view(np.int64))
                minima.append([int(mix(s * o).min().view(np.int64)) for o in odd])
                sketches.append(sketch(s))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, longs), pa.array(minima, longs), pa.array(sketches, pa.list_(pa.int32())), pa.array(outlines, pa.binary()), batch.column(2)], names=["id", "sid", "check", "n", "first", "minima", "sketch", "outline", "text_key"])

    return run


def _could_link(t: Fraction):
    """Keeps the pairs whose outlines leave room for the threshold: sets share at most the lesser count in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = lambda k: np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(f"outline_{k}")).to_pylist()), np.uint16).reshape(-1, OUTLINE)
            n = {k: batch.column(batch.schema.get_field_index(f"n_{k}")).to_numpy() for k in ("g", "h")}
            most = np.minimum(side("g"), side("h")).sum(axis=1, dtype=np.int64) if len(batch) else np.zeros(0, np.int64)
            keep = most * t.denominator >= t.numerator * (n["g"] + n["h"] - most)
            # counts of larger sets may not fit
            keep |= (n["g"] >= MOST_COUNT) | (n["h"] >= MOST_COUNT)
            yield batch.select(["g", "h"]).filter(pa.array(keep))

    return run


def _tokens(words: int):
    """The last column, a text, becomes the bytes of its sorted token hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(batch.num_columns - 1), words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*batch.schema.names[:-1], "tokens"])

    return run


def linked_members(a: list[np.ndarray], b: list[np.ndarray], t: Fraction) -> Iterator[np.ndarray]:
    """For each set of ``a``, the places in ``b`` of the sets that are linked with it; sets are sorted and not empty."""
    size_b = np.array([len(s) for s in b])
    flat = np.concatenate(b)
    order = np.argsort(flat, kind="stable")
    token, owner = flat[order], np.repeat(np.arange(len(b)), size_b)[order]
    for s in a:
        low = np.searchsorted(token, s, "left")
        many = np.searchsorted(token, s, "right") - low
        at = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
        same = np.bincount(owner[at], minlength=len(b))
        yield np.flatnonzero((same > 0) & (same * t.denominator >= t.numerator * (len(s) + size_b - same)))


def _compare(t: Fraction):
    """Of two blocks (sides 0 and 1; side 2 is in both) a row a member: its links with the other block and the least set that these links connect it to."""

    def run(table: pa.Table) -> pa.Table:
        sid, side = table.column("sid").to_numpy(), table.column("side").to_numpy()
        # documents that repeat id and text give their set several times
        _, first = np.unique(np.stack([sid, side]), axis=1, return_index=True)
        first = np.sort(first)
        sid, side = sid[first], side[first]
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").take(pa.array(first)).to_pylist()]
        rows, cols = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        links, root = np.zeros(len(sid), np.int64), np.arange(len(sid))
        if len(rows) and len(cols):
            for i, found in zip(rows, linked_members([sets[k] for k in rows], [sets[k] for k in cols], t), strict=True):
                found = cols[found]
                found = found[sid[found] != sid[i]]
                if not len(found):
                    continue
                links[i] += len(found)
                # a set on side 2 is a row and a column: each of its pairs comes twice, once from either end
                links[found[side[found] == 1]] += 1
                joined = np.unique(root[np.r_[i, found]])
                if len(joined) > 1:
                    root[np.isin(root, joined)] = joined[0]
        least = np.full(len(sid), np.iinfo(np.int64).max)
        np.minimum.at(least, root, sid)
        return pa.table({"sid": sid, "root": least[root], "links": links})

    return run


class JaccardJoin:
    """Links documents whose sets of ``words``-word n-grams have a Jaccard similarity of at least ``threshold``.

    A null text is empty; empty sets are linked with nothing. Documents with equal sets are linked and join as one
    set, whose identifier is a hash of it; ids may repeat or be null. ``result()`` has a row a document: id, text_key,
    n_shingles, component (an id of the component's sets), component_id (the component's least id; null if it has no
    ids), first (whether it is the component's document to keep) and n_links (how many other sets its set is linked with;
    documents with equal sets are one). ``one_of_each()`` keeps one document of each component.
    """

    def __init__(self, docs: DataFrame, words: int = 5, threshold: Fraction | str = "0.8", id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.words, self.t = docs.sparkSession, words, Fraction(threshold)
        if not 0 < self.t <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        small_batches(self.spark)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
        self.text_key = self._text_key(F.col("text"))

    @staticmethod
    def _text_key(text: Column) -> Column:
        return F.xxhash64(text, F.length(text))

    def _common(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that order last, and their weights. Their number is at most the mean size of a set over COMMON_SHARE."""
        found = cut(self.docs.select("text").mapInArrow(_common_tokens(self.words), "token long, many long, rows long").groupBy("token").agg(F.sum("many").alias("many"), F.sum("rows").alias("rows")).filter(f"many >= {COMMON_LEAST} OR rows > 0"), "jaccard-common")
        rows = found.agg(F.sum("rows")).first()[0] or 0
        kept = found.filter(F.col("many") >= max(COMMON_LEAST, int(rows * COMMON_SHARE))).select("token", "many").toArrow().to_pandas()
        token = kept.token.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(token)
        return token[order], kept.many.to_numpy(np.int64)[order]

    def _entries(self, groups: DataFrame) -> DataFrame:
        """The first tokens of each set: token, sid, n, rest (its tokens from this one on), root (of its group, if it has one)."""
        entries = self.wide.select("sid", "n", F.posexplode("first").alias("pos", "token")).select("token", "sid", "n", (F.col("n") - F.col("pos")).alias("rest"))
        return entries.join(self._small(groups), F.col("sid") == F.col("node"), "left").drop("node")

    def _matrix(self, groups: DataFrame) -> DataFrame:
        """The token-group matrix: token, g, least and most (sizes), rest (the most tokens of a member from this one on), several (whether the group has several members)."""
        entries = self._entries(groups)
        alone = entries.filter("root IS NULL").select("token", F.col("sid").alias("g"), F.col("n").alias("least"), F.col("n").alias("most"), "rest", F.lit(False).alias("several"))
        held = entries.filter("root IS NOT NULL").groupBy("token", F.col("root").alias("g")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.lit(True).alias("several"))
        return alone.unionByName(held)

    def _possible(self, x: str, y: str) -> Column:
        """Whether members of two rows of the matrix can be linked, their first common token being this one."""
        p, q = self.t.numerator, self.t.denominator
        c = lambda side, name: F.col(f"{side}.{name}")
        sizes = (c(x, "most") * q >= c(y, "least") * p) & (c(y, "most") * q >= c(x, "least") * p)
        return sizes & (F.least(c(x, "rest"), c(y, "rest")) * (p + q) >= (c(x, "least") + c(y, "least")) * p)

    def _small(self, df: DataFrame) -> DataFrame:
        """``df``, which ``cut`` wrote, to be broadcast if it has few rows."""
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    def _groups(self) -> DataFrame:
        """node and root of the sets that are in a group with others."""
        minima = self.wide.select("sid", "sketch", F.posexplode("minima").alias("i", "low"))
        leaders = cut(minima.groupBy("i", "low").agg(F.min(F.struct("sid", "sketch")).alias("b"), F.max("sid").alias("top")).filter("b.sid <> top").select("i", "low", "b"), "jaccard-leaders")
        some = lambda f: F.aggregate(F.zip_with(F.col("sketch"), F.col("b.sketch"), f), F.lit(0), lambda n, x: n + x.cast("int"))
        alike = some(lambda x, y: (x == y) & (x != 0)) >= ALIKE * some(lambda x, y: (x != 0) | (y != 0))
        edges = minima.join(self._small(leaders), ["i", "low"]).filter(alike).select(F.col("sid").alias("a"), F.col("b.sid").alias("b"))
        groups = cut(connected_components(edges), "jaccard-groups")
        discard(leaders)
        return groups

    def run(self) -> JaccardJoin:
        sent = self.spark.sparkContext.broadcast(self._common())
        schema = "id long, sid long, check long, n long, first array<long>, minima array<long>, sketch array<int>, outline binary, text_key long"
        self.sets = cut(self.docs.select("id", "text", self.text_key.alias("text_key")).mapInArrow(_sets(self.words, self.t, sent), schema), "jaccard-sets")
        # each set once, by its least id and that text; the arrays stay where they are
        name = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
        known = lambda: self.sets.filter("n > 0").groupBy("sid").agg(F.min(name).alias("r"), F.first("n").alias("n"), F.min("check").alias("check"), F.max("check").alias("most"))
        reps = cut(known(), "jaccard-reps")
        clash = reps.filter("check <> most").select("sid", F.lit(True).alias("clash"))
        if clash.limit(1).count():  # different sets of one hash: both hashes together name them
            apart, old = self.sets.join(clash, "sid", "left").withColumn("sid", F.when(F.col("clash"), F.xxhash64("sid", "check")).otherwise(F.col("sid"))).drop("clash"), (self.sets, reps)
            self.sets = cut(apart, "jaccard-sets")
            reps = cut(known(), "jaccard-reps")
            discard(*old)
        self.reps = reps.select("sid", "n", F.col("r.id").alias("id"), F.col("r.text_key").alias("text_key"))
        named = self.sets.filter("n > 0").select("sid", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), "text_key").join(self.reps.select("sid", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("best"), F.col("text_key").alias("best_key")), "sid")
        copies = cut(named.filter("name <> best OR text_key <> best_key").select("sid", "name", "text_key").distinct(), "jaccard-copies")
        self.wide = self.sets.filter("n > 0").withColumn("name", F.coalesce(F.col("id").cast("string"), F.lit(""))).join(self._small(copies), ["sid", "name", "text_key"], "left_anti")
        groups = self._groups()
        # which groups must be opened for each other
        matrix = self._matrix(groups)
        two = matrix.alias("x").join(matrix.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.g") < F.col("y.g")) & self._possible("x", "y"))
        two = cut(two.select(F.col("x.g").alias("g"), F.col("y.g").alias("h"), (F.col("x.several") | F.col("y.several")).alias("several")).distinct(), "jaccard-two")
        open_ = cut(two.filter("several").select("g", "h").unionByName(self._outlined(two.filter("NOT several").select("g", "h"))), "jaccard-open")
        found = self._open(groups, open_)
        edges = found.filter("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b"))
        self.roots = cut(connected_components(edges), "jaccard-roots")
        self.links = cut(found.groupBy("sid").agg(F.sum("links").alias("n_links")).filter("n_links > 0"), "jaccard-counts")
        discard(copies, groups, two, open_, found)
        return self

    def _outlined(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (g, h) of single sets that their outlines do not rule out."""
        ids = cut(pairs.select("g").unionByName(pairs.select(F.col("h").alias("g"))).distinct().withColumnRenamed("g", "sid"), "jaccard-ids")
        outlines = cut(self.wide.join(self._small(ids), "sid", "left_semi").select("sid", "n", "outline").dropDuplicates(["sid"]), "jaccard-outlines")
        side = lambda k: outlines.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("outline").alias(f"outline_{k}"))
        return pairs.join(side("g"), "g").join(side("h"), "h").mapInArrow(_could_link(self.t), "g long, h long")

    def _open(self, groups: DataFrame, two: DataFrame) -> DataFrame:
        """All comparisons: within each group, and of the smaller with the larger group of ``two``. A row a member and task: sid, root, links."""
        alone = F.coalesce("root", "sid").alias("g")
        held = self.reps.select("sid", (F.col("n") * 8).alias("bytes")).join(self._small(groups), F.col("sid") == F.col("node"), "left").select("sid", "bytes", alone, F.col("root").isNotNull().alias("several"))
        touched = two.select(F.col("g")).unionByName(two.select(F.col("h").alias("g"))).distinct().withColumn("touched", F.lit(True))
        held = cut(held.join(touched, "g", "left").filter("several OR touched").select("sid", "bytes", "g", "several"), "jaccard-held")
        blocks = F.greatest(F.ceil(F.col("bytes") / MOST_BLOCK), F.least(F.ceil(F.col("bytes") / LEAST_BLOCK), F.lit(FEW_BLOCKS))).cast("int")
        sizes = cut(held.groupBy("g").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("many")).withColumn("blocks", blocks), "jaccard-sizes")
        small = self._small(sizes)
        block = lambda of: F.pmod(F.xxhash64("sid"), F.col(of)).cast("int")
        within = held.filter("several").join(small, "g").filter("many > 1").select("sid", "g", block("blocks").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
        within = within.select("sid", F.lit(-1).cast("long").alias("g2"), "g", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.when(F.col("x") == F.col("y"), 2).when(F.col("x") < F.col("y"), 0).otherwise(1).alias("side"))
        # (the larger group, the smaller one); all smaller ones of a group are its queries together
        size = lambda k: small.select(F.col("g").alias(k), F.struct(F.col("many"), F.col("g").alias("id")).alias(f"{k}_size"))
        pairs = two.join(size("g"), "g").join(size("h"), "h")
        pairs = pairs.select(F.when(F.col("g_size") > F.col("h_size"), F.col("g")).otherwise(F.col("h")).alias("large"), F.when(F.col("g_size") > F.col("h_size"), F.col("h")).otherwise(F.col("g")).alias("g"))
        queries = pairs.join(held, "g").select("large", "sid", "bytes")
        asked = cut(queries.groupBy("large").agg(F.sum("bytes").alias("bytes")).withColumn("parts", blocks).select("large", "parts"), "jaccard-asked")
        several = self._small(asked)
        of = sizes.select(F.col("g").alias("large"), "blocks")
        of = F.broadcast(of) if small is not sizes else of
        queries = queries.join(several, "large").join(of, "large").select("sid", F.lit(0).cast("long").alias("g2"), F.col("large").alias("g"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), block("parts").alias("j"), F.lit(0).alias("side"))
        answers = held.join(several.withColumnRenamed("large", "g"), "g").join(small.select("g", "blocks"), "g").select("sid", F.lit(0).cast("long").alias("g2"), "g", block("blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(1).alias("side"))
        dealt = cut(within.unionByName(queries).unionByName(answers), "jaccard-dealt")
        # a set's least id and the text's hash pick its text; rows that repeat both have one text
        wanted = cut(self.reps.join(dealt.select("sid").distinct(), "sid", "left_semi").select("sid", "text_key", F.col("id").alias("rep")), "jaccard-wanted")
        texts = self.docs.withColumn("text_key", self.text_key)
        texts = texts.join(self._small(wanted), (texts.text_key == wanted.text_key) & texts.id.eqNullSafe(F.col("rep"))).select("sid", "text")
        tokens = texts.mapInArrow(_tokens(self.words), "sid long, tokens binary")
        found = cut(tokens.join(self._small(dealt), "sid").groupBy("g2", "g", "i", "j").applyInArrow(_compare(self.t), "sid long, root long, links long"), "jaccard-found")
        discard(held, sizes, asked, dealt, wanted)
        return found

    def result(self) -> DataFrame:
        name = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
        by_set = self.reps.join(self.roots, self.reps.sid == self.roots.node, "left").select("sid", name.alias("name"), F.coalesce("root", "sid").alias("component"))
        least = cut(by_set.groupBy("component").agg(F.min("name").alias("least")), "jaccard-least")
        found = cut(by_set.join(least, "component").select("sid", "component", "least").join(self.links, "sid", "left"), "jaccard-by-set")
        discard(least)
        out = self.sets.select("id", "n", "sid", "text_key").join(found, "sid", "left")
        empty = F.col("n") == 0
        return out.select(
            "id", "text_key", F.col("n").alias("n_shingles"),
            F.when(~empty, F.col("component")).alias("component"),
            F.when(empty, F.col("id")).otherwise(F.col("least.id")).alias("component_id"),
            (empty | (name == F.col("least"))).alias("first"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )

    def one_of_each(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` (those that were joined) without all but the first of each component: the one with the least id, then text hash; of rows that repeat both, one. Empty sets are components of their own. Columns of any name stay."""
        keys = [free_name(n, docs.columns) for n in ("__id", "__text_key")]
        key = dict(zip(keys, (F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), self._text_key(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))), strict=True))
        rows = self.result().select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias(keys[0]), F.col("text_key").alias(keys[1]), "first", "n_shingles")
        rows = cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("first").alias("first"), F.max("n_shingles").alias("size")).filter("NOT first OR (n > 1 AND size > 0)"), "jaccard-gone")
        gone, again = rows.filter("NOT first").select(*keys), rows.filter("first").select(*keys)
        small = rows.count() <= BROADCAST_IDS
        side = (lambda df: F.broadcast(df)) if small else (lambda df: df)
        left = docs.withColumns(key).join(side(gone), keys, "left_anti")
        if again.limit(1).count():
            left = left.join(side(again), keys, "left_anti").unionByName(left.join(side(again), keys, "left_semi").dropDuplicates(keys))
        return left.drop(*keys)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = JaccardJoin(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, threshold="0.85").run()
    return join.result().select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")
