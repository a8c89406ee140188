"""Words of Han texts, which are written without spaces: found in the texts, then used to cut them.

Discovery is one count of all grams and aggregates of it. What is counted and moved is one window of
LONGEST + 1 signs for each sign, with the windows of the same two first signs to one place; sorted as numbers, the windows of a
shorter gram stand side by side. Tasks count blocks of PIECE signs in numpy before windows move. A gram that is met once adds nothing to an
entropy, n * ln(n) being 0, and is part of no word that is met more often, so discovery leaves it out. A gram of two to LONGEST signs is a word if it is
frequent, coheres (its signs meet more often than the parts of any cut of it would by chance) and is free
(many different signs stand before and behind it). Its neighbours' entropy comes from the counts of the
grams that are one sign longer; an edge of a run counts as a neighbour of its own each time.

Segmentation takes the most likely words of a run: those with the largest sum of logarithms of their shares,
in whole millionths, by dynamic programming from the right. Of equally likely ones the first word is the
longer, then the second, and so on. Signs that the dictionary lacks are words by themselves. Runs of a batch go
side by side, a step for each distance from the end; where fewer than BESIDE are left, and for dictionaries with
words beyond PACKED signs, ``cut`` does the same for one run. ``refined`` cuts all runs and counts again, so a
word's share is that of its own uses, not of uses inside longer words.

A null or empty text has no words, and neither have texts without Han signs; grams may span at most a run of
them. Runs of any length are counted in blocks of PIECE signs that overlap. A dictionary holds the WORDS most
frequent words, a parameter of the model that bounds what workers hold; signs beyond them are unknown.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CJK_RUN, LATIN_TOKEN
from ..storage import materialise

LONGEST, LEAST = 4, 5
COHESION, FREEDOM = 1.5, 0.7  # in nats
ROUNDS = 2
WORDS = 200_000
PIECE = 1 << 21
BESIDE, PACKED = 24, 4
FIRST, LAST = 0x4E00, 0x9FFF  # of HAN; three bytes each in UTF-8
SIGN_BITS, SLOTS = 15, 4  # of windows as numbers
MICRO = 1_000_000
EDGE = "\u0002"
_LATIN = re.compile(LATIN_TOKEN)
#: Signs that are no terms of the keyword index when they are words by themselves.
STOP_SIGNS = (
    "的了是在有和就不太人这那也还我一个要会去与或于及之而但并其们"
    "对于为了以及根据相关包括如何什么怎么哪些为什么要需要可以应该"
    "我们你们他们这个那个这样那样时候地方情况问题办法方式途径通过"
    "进行使用用到做了着过吧吗呢哦啊呀呢因为所以然后接着接下来"
)


def _runs_of(text: str | None) -> list[str]:
    """The runs of Han signs of a text."""
    return re.findall(CJK_RUN, text or "")


def _signs(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs, places, text numbers): the Han signs of texts, where each stands and in which text; places of
    neighbours in a run differ by one, those of different texts by more."""
    kept = [t or "" for t in texts]
    points = np.frombuffer("\n".join(kept).encode("utf-32-le", "surrogatepass"), np.uint32)
    places = np.flatnonzero((points >= FIRST) & (points <= LAST))
    ends = np.cumsum([len(t) + 1 for t in kept]) if kept else np.zeros(0, int)
    return points[places].astype(np.int64), places, np.searchsorted(ends, places, "right")


def _starts(places: np.ndarray) -> np.ndarray:
    """Which signs begin a run."""
    return np.flatnonzero(np.concatenate([[True], np.diff(places) != 1])) if len(places) else np.zeros(0, int)


def _windows(texts: Iterable[str | None], size: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, counts): of each sign and each edge before a run, the size signs from there on, fewer at the end."""
    signs, places, _ = _signs(texts)
    starts = _starts(places)
    run = np.zeros(len(signs), np.int64)
    run[starts] = 1
    at = np.arange(len(signs)) + 3 * np.cumsum(run) - 2  # of a run: EDGE, its signs, EDGE, 0
    padded = np.zeros(len(signs) + 3 * len(starts) + size, np.uint32)
    padded[at] = signs
    padded[at[starts] - 1] = padded[at[np.append(starts[1:], len(signs)) - 1] + 1] = ord(EDGE)
    heads = np.sort(np.concatenate([at, at[starts] - 1]))
    for i in range(0, len(heads), piece):
        head = heads[i : i + piece]
        known, low = np.unique(padded[head[0] : head[-1] + size]), head[0]
        number = np.zeros(int(known[-1]) + 1, np.int64)
        number[known] = np.arange(len(known)) + (known[0] > 0)  # 0 stands for nothing
        base = len(known) + 1
        dense, inside = number[padded[low : head[-1] + size]], np.ones(len(head), bool)
        columns = []
        for k in range(size):
            column = np.where(inside, dense[head - low + k], 0)
            inside &= column > 0
            columns.append(column)
        if base**size < 1 << 63:
            code = columns[0]
            for column in columns[1:]:
                code = code * base + column
            code, n = np.unique(code, return_counts=True)
            found = np.empty((len(code), size), np.int64)
            for k in range(size - 1, -1, -1):
                code, found[:, k] = np.divmod(code, base)
        else:
            found, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        back = np.append(known, 0).astype(np.uint32)
        signs_of = np.where(found > 0, back[found - (known[0] > 0)], 0).astype(np.uint32)
        yield np.ascontiguousarray(signs_of).view(f"<U{size}")[:, 0], n


def _begun(batches: Iterator[tuple[np.ndarray, np.ndarray]], size: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, counts) of the beginnings of sorted windows with their counts; single signs are given by themselves.
    A beginning that goes on in the next batch is kept until it ends."""
    kept: dict[int, tuple[str, int]] = {}
    for windows, n in batches:
        matrix = np.ascontiguousarray(windows.astype(f"<U{size}")).view(np.uint32).reshape(len(windows), size)
        for k in range(1, size + 1):
            rows = np.flatnonzero(matrix[:, 1] == 0 if k == 1 else matrix[:, k - 1] != 0)
            if len(rows):
                grams = np.ascontiguousarray(matrix[rows, :k])
                first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)]))
                sums, names = np.add.reduceat(n[rows], first), grams[first].view(f"<U{k}")[:, 0]
                before = kept.get(k)
                if before and before[0] == names[0]:
                    sums[0] += before[1]
                elif before and (k == 1 or before[1] >= least):
                    yield np.array([before[0]]), np.array([before[1]])
                kept[k] = (str(names[-1]), int(sums[-1]))
                good = np.flatnonzero(sums[:-1] >= (least if k > 1 else 1))
                yield names[good], sums[good]
    for k, (name, total) in kept.items():
        if k == 1 or total >= least:
            yield np.array([name]), np.array([total])


def _batch(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(grams.tolist(), pa.string()), pa.array(n, pa.int64())], ["gram", "n"])


def _numbered(windows: np.ndarray, n: np.ndarray, size: int) -> pa.RecordBatch:
    """Windows as numbers of SLOTS signs each, which move and sort faster than texts: g0, g1 and so on, n."""
    matrix = np.ascontiguousarray(windows.astype(f"<U{size}")).view(np.uint32).reshape(len(windows), size).astype(np.int64)
    code = np.where(matrix >= FIRST, matrix - FIRST + 2, matrix > 0)  # 1 is an edge, 0 stands for nothing
    code = np.pad(code, ((0, 0), (0, -size % SLOTS))).reshape(len(windows), -1, SLOTS)
    packed = (code << np.arange(SIGN_BITS * (SLOTS - 1), -1, -SIGN_BITS)).sum(axis=2)
    return pa.RecordBatch.from_arrays([*map(pa.array, packed.T), pa.array(n, pa.int64())], [*(f"g{i}" for i in range(packed.shape[1])), "n"])


def _named(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, counts) of what _numbered() makes."""
    packed = np.stack([c.to_numpy() for c in batch.columns[:-1]], axis=1)
    code = (packed[:, :, None] >> np.arange(SIGN_BITS * (SLOTS - 1), -1, -SIGN_BITS)) & ((1 << SIGN_BITS) - 1)
    code = code.reshape(len(packed), -1)[:, :size]
    signs = np.where(code > 1, code + (FIRST - 2), code * ord(EDGE)).astype(np.uint32)
    return np.ascontiguousarray(signs).view(f"<U{size}")[:, 0], batch.column("n").to_numpy()


def gram_counts(docs: DataFrame, text: str, longest: int = LONGEST, least: int = 1) -> DataFrame:
    """(gram, n): grams of one to longest + 1 signs; EDGE stands before and behind each run. least: of longer grams
    than single signs only those with that many."""
    size, piece = longest + 1, PIECE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            signs, n = np.unique(_signs(texts)[0].astype(np.uint32), return_counts=True)
            yield _numbered(signs.view("<U1"), n, size)
            for windows, n in _windows(texts, size, piece):
                for i in range(0, len(n), 1 << 16):
                    yield _numbered(windows[i : i + (1 << 16)], n[i : i + (1 << 16)], size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = (_named(b, size) for b in batches if len(b))
        for grams, n in _begun(listed, size, least):
            yield _batch(grams, n)

    packed = [f"g{i}" for i in range(-(-size // SLOTS))]
    windows = docs.select(F.col(text).alias("t")).mapInArrow(count, ", ".join(f"{g} long" for g in packed) + ", n long")
    dealt = windows.repartition(F.shiftright("g0", SIGN_BITS * (SLOTS - 2))).sortWithinPartitions(*packed)  # all windows with a beginning of two signs or more
    return dealt.mapInArrow(add, "gram string, n long")


def _freedom(counts: DataFrame) -> DataFrame:
    """(word, n, freedom) of grams without an edge: freedom is the smaller of both sides' entropies."""
    size, inside = F.length("gram"), lambda c: F.when(c != EDGE, F.col("n") * F.log("n")).otherwise(0.0)
    first, last = F.substr("gram", F.lit(1), F.lit(1)), F.substr("gram", size, F.lit(1))
    none = F.lit(0).cast("long")
    own = F.struct(F.col("gram").alias("word"), F.lit(0.0).alias("l"), F.lit(0.0).alias("r"), F.col("n"))
    before = F.struct(F.substr("gram", F.lit(2)).alias("word"), inside(first).alias("l"), F.lit(0.0).alias("r"), none.alias("n"))
    behind = F.struct(F.substr("gram", F.lit(1), size - 1).alias("word"), F.lit(0.0).alias("l"), inside(last).alias("r"), none.alias("n"))
    sides = counts.where(size > 1).select(F.explode(F.array(own, before, behind)).alias("x")).select("x.*").where(~F.contains("word", F.lit(EDGE)) & (F.length("word") > 1))
    summed = sides.groupBy("word").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("r").alias("r")).where("n > 0")
    return summed.select("word", "n", (F.log("n") - F.greatest("l", "r") / F.col("n")).alias("freedom"))


def discover(docs: DataFrame, text: str, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, freedom: float = FREEDOM, counts: DataFrame | None = None) -> DataFrame:
    """(word, n, cohesion, freedom): the words of the texts. counts: gram_counts() of them, if they are stored."""
    counts = materialise(gram_counts(docs, text, longest, min(2, least)), "grams") if counts is None else counts
    total = counts.where(F.length("gram") == 1).agg(F.sum("n").alias("total"))  # one row
    size = F.length("word")
    free = _freedom(counts).where((size > 1) & (size <= longest) & (F.col("n") >= least) & (F.col("freedom") >= freedom))
    half = lambda i: F.array(F.struct(i.alias("cut"), F.substr("word", F.lit(1), i).alias("gram")), F.struct(i.alias("cut"), F.substr("word", i + 1).alias("gram")))
    parts = free.select("*", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), size - 1), half))).alias("p")).select("word", "n", "freedom", "p.*")
    known = parts.join(counts.where(~F.contains("gram", F.lit(EDGE))).withColumnRenamed("n", "of_part"), "gram")
    by_chance = [F.sum(F.when(F.col("cut") == i, F.log("of_part"))) for i in range(1, longest)]
    likely = known.groupBy("word", "n", "freedom").agg(F.greatest(*by_chance, F.lit(0.0)).alias("likely"))
    found = likely.crossJoin(F.broadcast(total)).select("word", "n", (F.log("n") + F.log("total") - F.col("likely")).alias("cohesion"), "freedom")
    return found.where(F.col("cohesion") >= cohesion)


def dictionary(found: DataFrame, counts: DataFrame, most: int = WORDS) -> DataFrame:
    """(word, n) of words and of single signs, the most frequent ones. counts: gram, n."""
    signs = counts.where((F.length("gram") == 1) & (F.col("gram") != EDGE)).select(F.col("gram").alias("word"), "n")
    return found.select("word", "n").unionByName(signs).orderBy(F.desc("n"), "word").limit(most)


def cut(run: str, weights: dict[str, int], unknown: int, longest: int) -> list[str]:
    """The most likely words of a run."""
    size = len(run)
    best, step = [0] * (size + 1), [1] * size
    for i in range(size - 1, -1, -1):
        best[i] = weights.get(run[i], unknown) + best[i + 1]
        for n in range(2, min(longest, size - i) + 1):
            weight = weights.get(run[i : i + n])
            if weight is not None and weight + best[i + n] >= best[i]:
                best[i], step[i] = weight + best[i + n], n
    words, i = [], 0
    while i < size:
        words.append(run[i : i + step[i]])
        i += step[i]
    return words


class Lexicon:
    """Weights of words of at most PACKED signs as arrays: of single signs by sign, of longer ones by their packed signs."""

    def __init__(self, weights: dict[str, int], unknown: int):
        self.unknown = unknown
        self.singles = np.full(1 << 16, unknown, np.int64)
        longer = {}
        for word, weight in weights.items():
            if all(FIRST <= ord(c) <= LAST for c in word):
                if len(word) == 1:
                    self.singles[ord(word)] = weight
                elif word:
                    longer[word] = weight
        self.longest = max(map(len, longer), default=1)
        self.names = list(longer)
        code = [sum(ord(c) << 16 * i for i, c in enumerate(reversed(w))) for w in longer]
        self.index = pd.Index(np.array(code, np.uint64))
        self.weights = np.array([*longer.values(), 0], np.int64)

    def step(self, signs: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """(weights, numbers), a column for each length: of the words that begin at each sign; numbers are -1 where there is none.
        left: signs from each one to its run's end."""
        numbers, weights = np.full((longest, len(signs)), -1, np.int64), np.zeros((longest, len(signs)), np.int64)
        weights[0], code = self.singles[signs], signs.astype(np.uint64)
        for n in range(2, longest + 1):
            code = code << np.uint64(16)
            code[: len(signs) - n + 1] |= signs[n - 1 :].astype(np.uint64)
            fits = np.flatnonzero(left >= n)
            numbers[n - 1, fits] = self.index.get_indexer(code[fits])
            weights[n - 1] = self.weights[numbers[n - 1]]
        return weights, numbers

    def cut(self, signs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begins, lengths, numbers) of the most likely words of runs, which begin at starts."""
        size, longest = len(signs), self.longest
        ends = np.append(starts[1:], size) if len(starts) else starts
        sizes = ends - starts
        weights, numbers = self.step(signs, np.repeat(ends, sizes) - np.arange(size), longest)
        steps = np.ones(size, np.int8)
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = ends[order], sizes[order]
        rest = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")  # runs that have so many signs
        deep = int((rest >= BESIDE).sum())  # so far from the end runs go side by side
        behind = [np.zeros(len(sizes), np.int64)] * longest  # best of the signs behind, nearest first
        first = int((sizes > deep).sum())
        ahead = np.zeros((longest, first), np.int64)
        for d in range(1, deep + 1):
            at = ends[: rest[d - 1]] - d
            best, step = weights[0, at] + behind[0][: len(at)], np.ones(len(at), np.int8)
            for n in range(2, min(longest, d) + 1):
                there = weights[n - 1, at] + behind[n - 1][: len(at)]
                better = (numbers[n - 1, at] >= 0) & (there >= best)
                best, step = np.where(better, there, best), np.where(better, n, step).astype(np.int8)
            steps[at] = step
            behind = [best, *behind[:-1]]
        for k in range(longest):
            ahead[k] = behind[k][:first]
        for r in range(first):  # what is left of the longest runs, one by one
            begin, end = int(ends[r] - sizes[r]), int(ends[r]) - deep
            ways, has = weights[:, begin:end].T.tolist(), (numbers[:, begin:end] >= 0).T.tolist()
            near, out = ahead[:, r].tolist(), [1] * (end - begin)
            for i in range(end - begin - 1, -1, -1):
                w, h = ways[i], has[i]
                best, step = w[0] + near[0], 1
                for n in range(1, longest):
                    if h[n] and w[n] + near[n] >= best:
                        best, step = w[n] + near[n], n + 1
                out[i] = step
                near = [best, *near[:-1]]
            steps[begin:end] = out
        begins = _follow(steps, starts, size)
        lengths = steps[begins]
        return begins, lengths, numbers[lengths - 1, begins]


def _follow(steps: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The places that are reached from starts by steps; a run's last step ends where the next one starts."""
    reached, at = np.zeros(size + 1, bool), starts
    reached[starts] = True
    ends = np.append(starts[1:], size) if len(starts) else starts
    while len(at) >= BESIDE:
        at = at + steps[at]
        on = at < ends
        at, ends = at[on], ends[on]
        reached[at] = True
    for i, end in zip(at.tolist(), ends.tolist(), strict=True):
        where, listed = [], steps[i:end].tolist()
        k = 0
        while k < end - i:
            where.append(k)
            k += listed[k]
        reached[np.array(where, int) + i] = True
    return np.flatnonzero(reached[:size])


_made: list[tuple[dict, Lexicon]] = []  # of a worker: the last one


def _lexicon(weights: dict[str, int], unknown: int) -> Lexicon:
    if not _made or _made[0][0] is not weights:
        _made[:] = [(weights, Lexicon(weights, unknown))]
    return _made[0][1]


def _blocks(texts: list[str | None], piece: int) -> Iterator[list[str | None]]:
    """texts in lists of about piece signs."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= piece:
            yield part
            part, size = [], 0
    if part:
        yield part


def _said(part: list[str | None], lexicon: Lexicon, terms: bool = False) -> pa.Array:
    """The words of each text, as lists; the texts' signs are their words' buffer. terms: without stop signs."""
    signs, places, of_text = _signs(part)
    begins, lengths, _ = lexicon.cut(signs, _starts(places))
    counts = np.bincount(of_text[begins], minlength=len(part)) if len(part) else np.zeros(0, int)
    data = signs.astype("<u2").tobytes().decode("utf-16-le").encode()
    offsets = pa.array((np.append(begins, len(signs)) * 3).astype(np.int32))
    words = pa.StringArray.from_buffers(len(begins), offsets.buffers()[1], pa.py_buffer(data))
    if terms:
        said = np.flatnonzero((lengths > 1) | ~np.isin(signs[begins], [ord(c) for c in STOP_SIGNS]))
        words, counts = words.take(pa.array(said)), np.bincount(of_text[begins[said]], minlength=len(part))
    return _listed(words, counts)


def _pairs(part: list[str | None]) -> pa.Array:
    """The two-letter shingles of each text's runs, as lists."""
    signs, places, of_text = _signs(part)
    first = np.flatnonzero(np.diff(places) == 1)
    data = np.stack([signs[first], signs[first + 1]], axis=1).astype("<u2").tobytes().decode("utf-16-le").encode()
    pairs = pa.StringArray.from_buffers(len(first), pa.py_buffer((6 * np.arange(len(first) + 1)).astype(np.int32)), pa.py_buffer(data))
    return _listed(pairs, np.bincount(of_text[first], minlength=len(part)))


def _latin(part: list[str | None]) -> pa.Array:
    """The Latin and digit words of each lower-case text, as lists."""
    return pa.array([[] if _LATIN.search(t or "") is None else _LATIN.findall(t) for t in part], pa.list_(pa.string()))


def _listed(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


def _together(lists: list[pa.Array]) -> pa.Array:
    """Lists of each row, one behind the other."""
    counts = [c.value_lengths().to_numpy() for c in lists]
    if all(not n.any() for n in counts[:-1]):
        return lists[-1]
    of_row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in counts])
    values = pa.concat_arrays([c.flatten() for c in lists])
    if sum(bool(n.any()) for n in counts) > 1:
        values = values.take(pa.array(np.argsort(of_row, kind="stable")))
    return _listed(values, sum(counts))


@dataclass(frozen=True)
class Terms:
    """Terms of the keyword index: those of tokens(), made in Arrow batches, then with a segmenter the words of Han runs but for
    stop signs. lists() has them without a column of lists."""

    segmenter: Segmenter | None = None

    def __call__(self, text: Column) -> Column:
        cut = self.cut

        @F.arrow_udf("array<string>")
        def run(batch: pa.Array) -> pa.Array:
            return cut(batch)

        return run(F.lower(text))

    def lists(self, low: pa.Array) -> Iterator[list[pa.Array]]:
        """Of lower-case texts, some at a time, the lists of their terms of each kind; null is as an empty text."""
        for part in _blocks(low.to_pylist(), PIECE):
            yield [_latin(part), _pairs(part), *([self.segmenter.said(part, True)] if self.segmenter else [])]

    def cut(self, low: pa.Array) -> pa.Array:
        """The terms of lower-case texts, as lists; those of null are null."""
        found = pa.concat_arrays([pa.array([], pa.list_(pa.string())), *map(_together, self.lists(low))])
        return found if not low.null_count else pc.if_else(low.is_valid(), found, pa.scalar(None, found.type))


shingles = Terms()


@dataclass(frozen=True)
class Segmenter:
    """weights: logarithms of shares, in millionths."""

    weights: Broadcast
    unknown: int
    longest: int

    def words(self, text: Column, terms: bool = False) -> Column:
        """The words of a text's runs, in their order. terms: without those that are a stop sign."""
        said, piece = self.said, PIECE

        @F.arrow_udf("array<string>")
        def segment(batch: pa.Array) -> pa.Array:
            parts = [said(part, terms) for part in _blocks(batch.to_pylist(), piece)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

        return segment(text)

    def said(self, part: list[str | None], terms: bool = False) -> pa.Array:
        """The words of texts, as lists, in a worker."""
        known = self.weights.value
        if self.longest > PACKED:
            return pa.array([[w for run in _runs_of(t) for w in cut(run, known, self.unknown, self.longest) if not terms or w not in STOP_SIGNS or len(w) > 1] for t in part], pa.list_(pa.string()))
        return _said(part, _lexicon(known, self.unknown), terms)

    def counted(self, docs: DataFrame, text: str) -> DataFrame:
        """(word, n) of the texts' words."""
        weights, unknown, longest, piece = self.weights, self.unknown, self.longest, PIECE

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, by_name = weights.value, Counter()
            lexicon = None if longest > PACKED else _lexicon(known, unknown)
            singles, longer = np.zeros(1 << 16, np.int64), np.zeros(len(lexicon.names) if lexicon else 0, np.int64)
            for batch in batches:
                texts = batch.column(0).to_pylist()
                if lexicon is None:
                    for t in texts:
                        for run in _runs_of(t):
                            by_name.update(cut(run, known, unknown, longest))
                    continue
                for part in _blocks(texts, piece):
                    signs, places, _ = _signs(part)
                    begins, lengths, numbers = lexicon.cut(signs, _starts(places))
                    singles += np.bincount(signs[begins[lengths == 1]], minlength=1 << 16)
                    longer += np.bincount(numbers[lengths > 1], minlength=len(longer))
            if lexicon is not None:
                by_name.update({chr(i): int(singles[i]) for i in np.flatnonzero(singles)})
                by_name.update({lexicon.names[i]: int(longer[i]) for i in np.flatnonzero(longer)})
            yield pa.RecordBatch.from_arrays([pa.array(list(by_name), pa.string()), pa.array(list(by_name.values()), pa.int64())], ["word", "n"])

        return docs.select(F.col(text).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    @property
    def tokens(self) -> Terms:
        """Terms of the keyword index: those of tokens(), then the words of Han runs but for stop signs."""
        return Terms(self)


def segmenter(spark: SparkSession, entries: DataFrame) -> Segmenter:
    """entries: word, n; at most WORDS of them."""
    rows = entries.where("n > 0").orderBy(F.desc("n"), "word").limit(WORDS).collect()
    total = sum(r["n"] for r in rows)
    weights = {r["word"]: round(math.log(r["n"] / total) * MICRO) for r in rows}
    least = min(weights.values(), default=0) - MICRO
    return Segmenter(spark.sparkContext.broadcast(weights), least, max(map(len, weights), default=1))


def refined(docs: DataFrame, text: str, entries: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n): what the texts' most likely words are and how often; longer ones used least times or more, and all signs."""
    found = segmenter(docs.sparkSession, entries).counted(docs, text)
    signs = entries.where(F.length("word") == 1).select("word", F.lit(1).cast("long").alias("n"))
    all_of = found.where((F.length("word") == 1) | (F.col("n") >= least)).unionByName(signs)  # a sign that is never alone has one use
    return all_of.groupBy("word").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "word").limit(WORDS)


def learn(docs: DataFrame, text: str, longest: int = LONGEST, least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """(word, n): a dictionary of the texts' words and signs."""
    counts = materialise(gram_counts(docs, text, longest, min(2, least)), "grams")
    entries = materialise(dictionary(discover(docs, text, longest, least, counts=counts), counts), "dictionary", most=WORDS)
    for _ in range(rounds):
        entries = materialise(refined(docs, text, entries, least), "dictionary", most=WORDS)
    return entries
