"""Encoding and decoding with a piece vocabulary (BPE with byte fallback), by merge rounds over flat symbol arrays.

A text becomes code points, with the mark ``▁`` for each space and one before the text. Between two characters that
stand side by side in no piece nothing is ever merged, so texts are cut there into words; equal words of a block are
encoded once. All words of a block are merged at once: in each round every word finds the least rank among its
adjacent pairs and merges the pairs of that rank, from the left; where a merge would make a pair that comes no later,
the word merges its leftmost pair alone, as the library's queue would. Words without a pair left leave the arrays.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from .common import bytes_of, mix, pieces, small_batches

MARK = "▁"
#: Code points that are merged together; more find more equal words, and take more memory (some 60 bytes each).
BLOCK = 1 << 20
#: Bytes of text or of tokens that a task turns into one Arrow batch.
BATCH_BYTES = 4 << 20
NONE = np.int32(2**31 - 1)
#: An odd multiplier of word hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _each_byte(wrong: UnicodeDecodeError) -> tuple[str, int]:
    return "�", wrong.start + 1


codecs.register_error("tessera.each", _each_byte)


@dataclass(frozen=True)
class PieceModel:
    """Pieces with scores and kinds (``n`` normal, ``b`` byte, ``c`` control, ``u`` unknown), as a model file has them."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str
    unknown: str

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a model by the library that defines the format; a model that this module would encode otherwise is refused."""
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(library.get_piece_size())
        kinds = "".join("u" if library.is_unknown(i) else "c" if library.is_control(i) else "b" if library.is_byte(i) else "x" if library.is_unused(i) else "n" for i in ids)
        model = cls(tuple(map(library.id_to_piece, ids)), tuple(map(library.get_score, ids)), kinds, library.decode([library.unk_id()]))
        if kinds.count("b") != 256 or "x" in kinds:
            raise ValueError("the model must have a piece for each byte and no unused pieces")
        for text in ("a  b c ", " ﬁ é é ▁x", "1234 https://a.b/c?d=e\n\n\tHello, WORLD! 中文\U0001f600", "aaaaaaaaa bananas " + " " * 40 + "x"):
            ids, starts = tables(model).encode(*bytes_of(pa.array([text])))
            if ids.tolist() != library.encode(text):
                raise ValueError("the model does not encode by byte-pair merges over unchanged text")
        return model


class Tables:
    """What encoding and decoding look up; made once in a worker from the model."""

    def __init__(self, model: PieceModel):
        normal = [i for i, k in enumerate(model.kinds) if k == "n"]
        number = {model.pieces[i]: i for i in normal}
        self.byte_ids = np.array([i for i, k in enumerate(model.kinds) if k == "b"], np.int32)
        chars = sorted({c for i in normal for c in model.pieces[i]})
        self.known = len(chars)
        index = {c: k for k, c in enumerate(chars)}
        self.char_at = np.full(0x110000, self.known, np.int32)
        self.char_at[[ord(c) for c in chars]] = np.arange(self.known)
        self.codes = np.array([ord(c) for c in chars] or [0], np.uint32)
        self.size = len(model.pieces)
        # a character without a piece of its own is a symbol beyond all pieces
        symbol = {c: number.get(c, self.size + k) for c, k in index.items()}
        self.symbol = np.array([*symbol.values(), self.size + self.known], np.int32)
        self.beside = np.zeros((self.known + 1, self.known + 1), bool)
        rank_of = np.unique(-np.array(model.scores), return_inverse=True)[1]
        pairs = {}
        for text, i in number.items():
            for k in range(1, len(text)):
                self.beside[index[text[k - 1]], index[text[k]]] = True
                left, right = text[:k], text[k:]
                left, right = number.get(left, symbol[left] if k == 1 else None), number.get(right, symbol[right] if k == len(text) - 1 else None)
                if left is not None and right is not None:
                    pairs[left * (self.size + self.known + 1) + right] = (rank_of[i], i)
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.ranks = np.array([pairs[k][0] if k in pairs else NONE for k in self.keys.tolist()], np.int32)
        self.makes = np.array([pairs[k][1] if k in pairs else 0 for k in self.keys.tolist()], np.int32)
        self.hashes = mix(np.arange(1, 0x110001, dtype=np.uint64))
        self.mark = int(self.char_at[ord(MARK)])
        self.marks_cut = self._marks_cut(number)
        surface = [b"" if k == "c" else model.unknown.encode() if k == "u" else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds)]
        for b, i in enumerate(self.byte_ids.tolist()):
            surface[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(surface) or b"\0", np.uint8)
        self.surface_at = np.cumsum([0, *map(len, surface)])
        self.silent = np.array([k == "c" for k in model.kinds])
        self.marked = np.array([k == "n" and p.startswith(MARK) for p, k in zip(model.pieces, model.kinds)])

    def _marks_cut(self, number: dict[str, int]) -> int:
        """Every how many marks a long run of them may be cut, 0 for never: marks join from the left, after all else, up to the longest piece of marks."""
        if any(MARK * 2 in p and set(p) != {MARK} or MARK in p.lstrip(MARK) and set(p) != {MARK} for p in number):
            return 0
        longest = max((len(p) for p in number if set(p) == {MARK}), default=0)
        if longest < 2:
            return 0
        one = int(self.symbol[self.mark])
        worst = self.pairs(np.array([one]), np.array([one]))[0][0]
        if worst == NONE or worst < self.ranks.max():
            return 0
        lengths = [self.merged(np.full(n, one, np.int32), np.array([n]))[0].tolist() for n in range(1, 4 * longest)]
        whole = number[MARK * longest]
        return longest if all(lengths[n - 1] == [whole, *lengths[n - longest - 1]] for n in range(longest + 1, 4 * longest)) else 0

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; ``NONE`` where the two make no piece."""
        key = left.astype(np.int64) * (self.size + self.known + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.makes[at], 0)

    def merged(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words (flat) after all merges, and how many each word has."""
        count, done = len(lens), []
        if not count:
            return symbols, lens
        symbols, lens, word = symbols.copy(), lens.astype(np.int64), np.arange(count)
        rank, makes = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int32)
        rank[:-1], makes[:-1] = self.pairs(symbols[:-1], symbols[1:])
        rank[np.cumsum(lens) - 1] = NONE
        while len(word):
            least = np.minimum.reduceat(rank, np.cumsum(lens) - lens)
            still = least < NONE
            if not still.all():
                gone = np.repeat(~still, lens)
                done.append((word[~still], lens[~still], symbols[gone]))
                symbols, rank, makes = symbols[~gone], rank[~gone], makes[~gone]
                word, lens, least = word[still], lens[still], least[still]
                if not len(word):
                    break
            owner = np.repeat(np.arange(len(word)), lens)
            at = np.flatnonzero(rank == least[owner])
            # of pairs that overlap, every other one, from the left
            k = np.arange(len(at))
            fresh = np.ones(len(at), bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            at = at[(k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0]
            at = self._in_order(symbols, makes, owner, least, at)
            symbols[at] = makes[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            lens = lens - np.bincount(owner[at], minlength=len(lens))
            symbols, rank, makes = symbols[keep], rank[keep], makes[keep]
            place = at - np.arange(len(at))
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(lens) - 1] = True
            touched = np.concatenate([place, place[place > 0] - 1])
            rank[touched] = NONE
            touched = touched[~last[touched]]
            rank[touched], makes[touched] = self.pairs(symbols[touched], symbols[touched + 1])
        words = np.concatenate([d[0] for d in done])
        counts = np.concatenate([d[1] for d in done])
        flat = np.concatenate([d[2] for d in done])
        order = np.argsort(words, kind="stable")
        starts = np.cumsum(counts) - counts
        return flat[spread(starts[order], counts[order])], counts[order]

    def _in_order(self, symbols: np.ndarray, makes: np.ndarray, owner: np.ndarray, least: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``at``, but for words where one of several merges makes a pair of no greater rank: these keep their first merge alone."""
        several = np.bincount(owner[at], minlength=len(least))[owner[at]] > 1
        if not several.any():
            return at
        some = at[several]
        mine, new, limit = owner[some], makes[some], least[owner[some]]
        bad = np.zeros(len(least), bool)
        for step, other in ((-1, symbols), (2, symbols)):
            there = np.clip(some + step, 0, len(symbols) - 1)
            beside = (there == some + step) & (owner[there] == mine)
            pair = (other[there], new) if step < 0 else (new, other[there])
            bad[mine[beside & (self.pairs(*pair)[0] <= limit)]] = True
        touch = np.flatnonzero(some[1:] == some[:-1] + 2)
        bad[mine[touch[(owner[some[touch]] == owner[some[touch + 1]]) & (self.pairs(new[touch], new[touch + 1])[0] <= limit[touch])]]] = True
        first = np.ones(len(at), bool)
        first[1:] = owner[at[1:]] != owner[at[:-1]]
        return at[first | ~bad[owner[at]]]

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and each text's start; one more start ends the last."""
        codes, begins = code_points(data, starts)
        full = np.flatnonzero(np.diff(begins))
        codes = np.where(codes == 32, np.uint32(ord(MARK)), codes)
        codes = np.insert(codes, begins[full], np.uint32(ord(MARK)))
        begins = begins + np.concatenate([[0], np.cumsum(np.diff(begins) > 0)])
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        chars = self.char_at[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.beside[chars[:-1], chars[1:]]
        cut[begins[full]] = True
        if self.marks_cut:
            runs = chars == self.mark
            runs_begin = np.flatnonzero(runs & (cut | np.concatenate([[True], ~runs[:-1]])))
            stop = np.flatnonzero(runs & np.concatenate([~runs[1:] | cut[1:], [True]])) + 1
            times = (stop - runs_begin - 1) // self.marks_cut
            for b, t in zip(runs_begin[times > 0].tolist(), times[times > 0].tolist()):
                cut[b + self.marks_cut * np.arange(1, t + 1)] = True
        words = np.append(np.flatnonzero(cut), len(codes))
        out, counts, i = [], [], 0
        while i < len(words) - 1:
            j = max(i + 1, int(np.searchsorted(words, words[i] + BLOCK, side="right")) - 1)
            a, b = words[i], words[j]
            ids, n = self._block(codes[a:b], chars[a:b], words[i : j + 1] - a)
            out.append(ids)
            counts.append(n)
            i = j
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(out), ends[np.searchsorted(words, begins)]

    def _block(self, codes: np.ndarray, chars: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's words, flat, and how many each word has."""
        begin, lens = words[:-1], np.diff(words)
        which, first = same_words(self.hashes[codes], codes, begin, lens)
        size = lens[first]
        flat = spread(begin[first], size)
        symbols = self.symbol[chars[flat]]
        ids, counts = self.merged(symbols, size)
        strange = np.flatnonzero(ids >= self.size)
        if len(strange):
            char = ids[strange] - self.size
            word = np.searchsorted(np.cumsum(counts), strange, side="right")
            # a character that no piece has stands alone in its word
            code = np.where(char < self.known, self.codes[np.minimum(char, len(self.codes) - 1)], codes[begin[first][word]])
            raw = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
            each = np.ones(len(ids), np.int64)
            each[strange] = width
            grown = np.repeat(ids, each)
            grown[spread((np.cumsum(each) - each)[strange], width)] = self.byte_ids[raw]
            ids, counts = grown, counts + np.bincount(word, weights=width - 1, minlength=len(counts)).astype(np.int64)
        at = np.cumsum(counts) - counts
        return ids[spread(at[which], counts[which])], counts[which]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The UTF-8 of all texts one after the other, and each text's start."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError(f"ids must be from 0 to {self.size - 1}")
        at, size = self.surface_at[ids], np.diff(self.surface_at)[ids]
        heard = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
        lead = heard[np.searchsorted(heard, starts[:-1])]
        lead = lead[lead < starts[1:]]
        lead = lead[self.marked[ids[lead]]]  # the mark put before the text
        at[lead] += 1
        size[lead] -= 1
        data = self.surface[spread(at, size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        silent = np.flatnonzero(self.silent[ids])
        if not len(silent):
            try:
                whole = data.tobytes()
                whole.decode()
                return whole, ends[starts]
            except UnicodeDecodeError:
                pass
        # bytes make one character only where no other piece stands between them, not even one without a text
        cuts = np.unique(np.concatenate([starts, silent]))
        at = ends[cuts]
        texts = [data[a:b].tobytes().decode("utf-8", "tessera.each").encode() for a, b in zip(at[:-1], at[1:])]
        return b"".join(texts), np.cumsum([0, *map(len, texts)])[np.searchsorted(cuts, starts)]


@lru_cache(maxsize=2)
def tables(model: PieceModel) -> Tables:
    return Tables(model)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[0] .. starts[0] + sizes[0] - 1``, then those of the next, and so on."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def code_points(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and each text's start among them; each byte that is no UTF-8 is U+FFFD."""
    try:
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return codes, heads[starts]
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "tessera.each") for a, b in zip(starts[:-1], starts[1:])]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, INVERSE))


def same_words(values: np.ndarray, codes: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its kind, and for each kind one word of it; words of a kind are equal code by code."""
    up, down = _powers(max(BLOCK, 1 << int(len(codes)).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * up[: len(codes)], out=sums[1:])
    keys = (sums[begin + lens] - sums[begin]) * down[begin]
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    like = first[which]
    differ = lens != lens[like]
    alike = np.flatnonzero(~differ & (like != np.arange(len(lens))))
    size = lens[alike]
    apart = codes[spread(begin[alike], size)] != codes[spread(begin[like[alike]], size)]
    if apart.any():
        differ[alike[np.repeat(np.arange(len(alike)), size)[apart]]] = True
    if differ.any():  # words of one hash that are not equal are kinds of their own
        own = np.flatnonzero(differ)
        which = which.copy()
        which[own] = len(first) + np.arange(len(own))
        first = np.concatenate([first, own])
    return which, first


def _mapped(df: DataFrame, column: str, out_col: str, made: DataType, work) -> DataFrame:  # noqa: ANN001
    """``df`` with ``out_col`` (one of that name is replaced) made of ``column`` by ``work`` on Arrow batches, in which it is the last column."""
    keep = [c for c in df.columns if c != out_col]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias(out_col))
    return rows.mapInArrow(work, StructType([*rows.schema.fields[:-1], StructField(out_col, made)]))


def encode(df: DataFrame, model: PieceModel, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with the array ``out_col`` of each whole text's ids, without begin or end ids.

    A null or empty text has no ids. Rows are encoded one by one, so ties and repeated rows are alike and an empty
    table stays empty; a column named as ``out_col`` is replaced, others of any name are kept. A very long text is
    merged in blocks of words, so that its arrays beyond the ids and code points stay of one size. No row is shuffled.
    """
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = tables(model)
        for batch in batches:
            data, starts = bytes_of(batch.column(batch.num_columns - 1))
            for i, j in pieces(starts, BATCH_BYTES):
                ids, at = look.encode(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                made = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[:-1]], made], names=batch.schema.names)

    return _mapped(df, text_col, out_col, ArrayType(IntegerType()), work)


def decode(df: DataFrame, model: PieceModel, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the string ``out_col`` that each array of ids decodes to.

    A null array decodes to the empty text, a null id in an array and one outside the vocabulary raise an error.
    Bytes that make no UTF-8 become U+FFFD each. Empty tables, repeated rows and clashing names are as in ``encode``.
    """
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = tables(model)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            ids = column.flatten()
            if ids.null_count:
                raise ValueError("an array of ids holds a null")
            ids = ids.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for i, j in pieces(starts, BATCH_BYTES // 4):
                text, at = look.decode(ids[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                made = pa.StringArray.from_buffers(j - i, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(text))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[:-1]], made], names=batch.schema.names)

    return _mapped(df, ids_col, out_col, StringType(), work)


def op13_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Each document's number of ids, and digests of its ids and of the text that they decode to; nulls, empty and long texts as in ``encode``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = PieceModel.load(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode(encode(docs, model).drop("text"), model)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
