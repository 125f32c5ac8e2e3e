"""Phrase collocation mining with pivot partitions: a phrase is counted where its rarest word is.

Words are numbered by how common they are. Each occurrence of a word sends the words around it, as far as they are no
rarer, to the word's own bucket; there all phrases of which it is the rarest word are counted level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, partitions

#: Bytes that are tokenised together, words after which a task passes on what it has, words a bucket stands for.
SLICE, FLUSH, BUCKET = 1 << 20, 3_000_000, 1_000_000
#: Words that are numbered: 12 bytes each in every worker. Rarer ones keep their hash and count as rarer than all numbered.
NUMBERED = 4_000_000
#: Words that are more than this share of all: their phrases are counted before they are sent, and dealt by phrase.
HOT = 1 / 1024
#: The places of a phrase in a fragment of 3 + 1 + 3 words, as (first, length): all hold the middle.
PLACES = {n: [(s, n) for s in range(4 - n, 4)] for n in (2, 3, 4)}
NONE = np.uint64(2**64 - 1)
_CLASS = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_CLASS[[9, 32]] = 1
_CLASS[list(b".,;:!?\n\v\f\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPES = np.array([[3 - left <= k <= 3 + right for k in range(7)] for left in range(4) for right in range(4)])
_BASE = 0x9E6C63D0876A9A47
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(n, np.uint64(base))
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers = tuple(tables)
    return _powers


class Words(NamedTuple):
    """Words of a slice: hash (63 bits), row, number of the piece, and their lower-cased bytes by place."""

    hash: np.ndarray
    row: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def tokenise(column: pa.StringArray, seeds: np.ndarray) -> Iterator[Words]:
    """The words of texts that each end in a line end, in slices of whole pieces; hashes tell rows of other seeds apart."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return
    every = np.frombuffer(column.buffers()[2], np.uint8)
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        size = SLICE
        while True:
            part = every[at : min(at + size, last)]
            kinds = _CLASS[part]
            if at + size >= last or (breaks := np.flatnonzero(kinds == 2)).size:
                break
            size *= 2  # a piece that is longer than a slice
        if at + size < last:
            part, kinds = part[: breaks[-1] + 1], kinds[: breaks[-1] + 1]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = kinds == 0
        edges = np.diff(inside)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if start.size:
            data = _LOWER[part]
            power, inverse = _power_tables(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
            row = np.searchsorted(offsets, at + start, side="right") - 1
            with np.errstate(over="ignore"):
                h = _mixed((sums[end] - sums[start]) * inverse[start] ^ seeds[row]) >> np.uint64(1)
            yield Words(h, row, np.cumsum(kinds == 2, dtype=np.int32)[start], start, end, data)
        at += len(part)


def _spelled(w: Words, at: np.ndarray) -> pa.StringArray:
    """The words at some places as text."""
    start, size = w.start[at], w.end[at] - w.start[at]
    offsets = np.zeros(len(at) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    data = w.data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _seeds(langs: list[str]) -> np.ndarray:
    known = {x: xxhash.xxh64_intdigest(x, 11) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def _counted_words(batches) -> Iterator[pa.RecordBatch]:
    """lang, h, word, n: words of a task, counted before they are shuffled."""
    found, held = [], 0

    def merged():
        h, n = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        own, first, group = np.unique(h, return_index=True, return_inverse=True)
        lang, word = (pa.concat_arrays([x[k] for x in found]).take(pa.array(first)) for k in (2, 3))
        return [(own, np.bincount(group, weights=n).astype(np.int64), lang, word)]

    def out():
        h, n, lang, word = merged()[0]
        for k in range(0, len(h), 20_000):
            part = slice(k, k + 20_000)
            yield pa.RecordBatch.from_arrays([lang[part], pa.array(h[part].view(np.int64)), word[part], pa.array(n[part])], names=["lang", "h", "word", "n"])

    for b in batches:
        langs = b.column(0)
        for w in tokenise(b.column(1), _seeds(langs.to_pylist())):
            own, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            found.append((own, n, langs.take(pa.array(w.row[first])), _spelled(w, first)))
            held += len(own)
            if held > FLUSH // 2:
                found = merged()
                held = len(found[0][0])
                if held > FLUSH // 4:
                    yield from out()
                    found, held = [], 0
    if found:
        yield from out()


def vocabulary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word, h (its hash within the language), n (its occurrences). Two words of one hash end the job: hashes stand for words after this."""
    bounded_batches(docs.sparkSession, rows=10_000)
    counted = _slim(docs, text_col, lang_col).mapInArrow(_counted_words, "lang string, h long, word string, n long")
    whole = counted.groupBy("h").agg(F.min(F.struct("lang", "word")).alias("w"), F.max(F.struct("lang", "word")).alias("w2"), F.sum("n").alias("n"))
    word = F.when(F.col("w") == F.col("w2"), F.col("w")).otherwise(F.raise_error(F.concat(F.lit("one hash for two words: "), F.to_json("w"), F.to_json("w2"))))
    return whole.select(word.alias("w"), "h", "n").select("w.*", "h", "n")


def _slim(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.concat(F.coalesce(text_col, F.lit("")), F.lit("\n")).alias("text"))


class Numbers(NamedTuple):
    """Words by how common they are: hashes in order, their numbers (0: the most common), whether no frequent word is left out, and how many are hot."""

    hashes: np.ndarray
    number: np.ndarray
    complete: bool
    hot: int

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Numbers; NONE for words below the least count. A word without a number has its hash with the top bit: rarer than all numbered."""
        rest = np.full(len(h), NONE) if self.complete else h | np.uint64(1 << 63)
        if not len(self.hashes):
            return rest
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.number[at], rest)

    def hashed(self, codes: np.ndarray) -> np.ndarray:
        """The hashes of codes."""
        by_number = np.empty(len(self.hashes), np.uint64)
        by_number[self.number] = self.hashes
        known = codes < np.uint64(len(by_number))
        out = codes & np.uint64((1 << 63) - 1)
        out[known] = by_number[codes[known].astype(np.int64)]
        return out


def number_words(vocab: DataFrame, least: int, most: int = NUMBERED) -> Numbers:
    """The numbers of the words that occur `least` times, of the `most` commonest at most."""
    frequent = vocab.where(F.col("n") >= least)
    levels = sorted(((r["n"], r["words"]) for r in frequent.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    kept, cutoff = 0, None
    for n, words in levels:
        if kept + words > most:
            break
        kept, cutoff = kept + words, n
    total = vocab.agg(F.sum("n")).first()[0] or 0
    if cutoff is None:
        return Numbers(np.empty(0, np.uint64), np.empty(0, np.uint64), not levels, 0)
    found = frequent.where(F.col("n") >= cutoff).select("h", "n").toArrow()
    h, n = (found.column(c).to_numpy() for c in ("h", "n"))
    order = np.lexsort((h, -n))
    number = np.empty(len(h), np.uint64)
    number[order] = np.arange(len(h), dtype=np.uint64)
    by_hash = np.argsort(h)
    return Numbers(h[by_hash].view(np.uint64), number[by_hash], cutoff == levels[-1][0], int((n > total * HOT).sum()))


def fragments(codes: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of 3 + 1 + 3 words around each word, and its shape (4 * words to the left + words to the right).

    To the left come words that are more common, to the right also the word itself: so a phrase that holds its rarest
    word twice is found at the first of them only. Words alone are left out.
    """
    n = len(codes)
    wide = np.concatenate((np.full(3, NONE), codes, np.full(3, NONE)))
    near = np.concatenate((np.full(3, -1, np.int32), piece, np.full(3, -1, np.int32)))
    reach = {}
    for side in (-1, 1):
        open_, count = codes != NONE, np.zeros(n, np.uint8)
        for k in (1, 2, 3):
            at = slice(3 + side * k, 3 + side * k + n)
            other = wide[at]
            open_ = open_ & (near[at] == piece) & ((other < codes) if side < 0 else (other <= codes))
            count += open_
        reach[side] = count
    shape = 4 * reach[-1] + reach[1]
    at = np.flatnonzero(shape)
    return wide[at[:, None] + np.arange(7)], shape[at]


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows together, and where groups of them begin in it."""
    if rows.shape[1] <= 4 and rows.size and rows.max() < 2**32:
        keys = [rows[:, k] << np.uint64(32) | (rows[:, k + 1] if k + 1 < rows.shape[1] else np.uint64(0)) for k in range(0, rows.shape[1], 2)]
    else:
        keys = list(rows.T)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    differs = np.zeros(len(order), bool)
    differs[:1] = True
    for k in keys:
        differs[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(differs)


def _tally(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their weights."""
    order, first = _runs(rows)
    return rows[order[first]], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def _phrases(rows: np.ndarray, shape: np.ndarray, n: int) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """For each place of a phrase of n words: the fragments that reach so far."""
    left, right = shape // 4, shape % 4
    for s, _ in PLACES[n]:
        yield (s, n), (left >= 3 - s) & (right >= s + n - 4)


def _padded(rows: np.ndarray) -> np.ndarray:
    return np.concatenate((rows, np.full((len(rows), 4 - rows.shape[1]), NONE)), axis=1)


def _packed(codes: np.ndarray, narrow: bool) -> bytes:
    """Codes as 32 bits where all are numbers; NONE is the largest value of either width."""
    return codes.astype(np.uint32).tobytes() if narrow else codes.tobytes()


def _unpacked(data, narrow: bool) -> np.ndarray:
    if not narrow:
        return np.frombuffer(data, np.uint64)
    codes = np.frombuffer(data, np.uint32)
    return np.where(codes == np.uint32(2**32 - 1), NONE, codes.astype(np.uint64))


def _route(batches, numbers, buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, kind, data: fragments of words by their rarest word (kind 0), and counted phrases of hot words by phrase (kind 1)."""
    numbers = numbers.value
    cold, hot, held = [], [], 0

    def out():
        if cold:
            rows, shape = (np.concatenate([x[k] for x in cold]) for k in (0, 1))
            bucket = (_mixed(rows[:, 3]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, shape, bucket = rows[order], shape[order], bucket[order]
            reach = _SHAPES[shape]
            flat, ends = rows[reach], np.cumsum(reach.sum(axis=1))
            own, at = np.unique(bucket, return_index=True)
            stops = np.append(at[1:], len(bucket))
            data = [np.uint32(b - a).tobytes() + shape[a:b].tobytes() + _packed(flat[ends[a - 1] if a else 0 : ends[b - 1]], numbers.complete) for a, b in zip(at, stops)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([0] * len(own), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])
        if hot:
            rows, n = _tally(*(np.concatenate([x[k] for x in hot]) for k in (0, 1)))
            key = rows[:, 0]
            for k in (1, 2, 3):
                key = _mixed(key ^ rows[:, k])
            bucket = (_mixed(key) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, n, bucket = rows[order], n[order], bucket[order]
            own, at = np.unique(bucket, return_index=True)
            data = [np.uint32(b - a).tobytes() + n[a:b].tobytes() + _packed(rows[a:b], numbers.complete) for a, b in zip(at, np.append(at[1:], len(bucket)))]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([1] * len(own), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])

    for b in batches:
        for w in tokenise(b.column(1), _seeds(b.column(0).to_pylist())):
            rows, shape = fragments(numbers.codes(w.hash), w.piece)
            common = rows[:, 3] < np.uint64(numbers.hot)
            cold.append((rows[~common], shape[~common]))
            rows, shape = rows[common], shape[common]
            for n in PLACES:
                for (s, _), has in _phrases(rows, shape, n):
                    hot.append(_tally(_padded(rows[has][:, s : s + n]), np.ones(int(has.sum()), np.int64)))
            held += len(w.hash)
            if held > FLUSH // 3:
                yield from out()
                cold, hot, held = [], [], 0
    yield from out()


def _mined(rows: np.ndarray, shape: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of the middle words of fragments with `least` occurrences, and these: a phrase is looked at only if those in it that hold the middle have as many."""
    frequent: dict[tuple[int, int], np.ndarray] = {}
    for n in PLACES:
        places = []
        for (s, _), has in _phrases(rows, shape, n):
            for inner in ((s, n - 1), (s + 1, n - 1)):
                if inner in frequent:
                    has = has & frequent[inner]
            places.append(((s, n), np.flatnonzero(has)))
        every = np.concatenate([rows[at][:, s : s + n] for (s, _), at in places])
        order, first = _runs(every)
        counts = np.diff(np.append(first, len(order)))
        enough = np.zeros(len(order), bool)
        enough[order] = np.repeat(counts >= least, counts)
        yield _padded(every[order[first[counts >= least]]]), counts[counts >= least]
        upto = 0
        for place, at in places:
            frequent[place] = np.zeros(len(rows), bool)
            frequent[place][at[enough[upto : upto + len(at)]]] = True
            upto += len(at)


def _mine(batches, numbers, least: int) -> Iterator[pa.RecordBatch]:
    """c (the hashes of a phrase's words), a (its occurrences) for each bucket; rows come sorted by bucket."""
    numbers = numbers.value
    width = 4 if numbers.complete else 8

    def counted(held):
        rows, shapes, ready, weights = [], [], [], []
        for kind, data in held:
            n = int(np.frombuffer(data[:4], np.uint32)[0])
            if kind == 0:
                shape = np.frombuffer(data[4 : 4 + n], np.uint8)
                wide = np.full((n, 7), NONE)
                wide[_SHAPES[shape]] = _unpacked(data[4 + n :], width == 4)
                rows.append(wide)
                shapes.append(shape)
            else:
                weights.append(np.frombuffer(data[4 : 4 + 8 * n], np.int64))
                ready.append(_unpacked(data[4 + 8 * n :], width == 4).reshape(n, 4))
        found = list(_mined(np.concatenate(rows), np.concatenate(shapes), least)) if rows else []
        if ready:
            own, n = _tally(np.concatenate(ready), np.concatenate(weights))
            found.append((own[n >= least], n[n >= least]))
        codes, a = np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found]).astype(np.int64)
        size = (codes != NONE).sum(axis=1)
        flat = numbers.hashed(codes[codes != NONE]).view(np.int64)
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(a)], names=["c", "a"])

    now, held = None, []
    for b in batches:
        for bucket, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if bucket != now and held:
                yield counted(held)
                held = []
            now = bucket
            held.append((kind, data))
    if held:
        yield counted(held)


def frequent_phrases(docs: DataFrame, vocab: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang", most: int = NUMBERED) -> DataFrame:
    """c (hashes of 2 to 4 words), a: all phrases with `least` occurrences or more within pieces, overlaps included."""
    spark = docs.sparkSession
    numbers = number_words(vocab, least, most)
    words = vocab.agg(F.sum("n")).first()[0] or 0
    shared = spark.sparkContext.broadcast(numbers)
    buckets = max(256, -(-words // BUCKET))
    bounded_batches(spark, rows=10_000)
    routed = _slim(docs, text_col, lang_col).mapInArrow(partial(_route, numbers=shared, buckets=buckets), "bucket int, kind int, data binary")
    dealt = routed.repartition(max(partitions(docs), buckets // 8), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(partial(_mine, numbers=shared, least=least), "c array<long>, a long")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, text_col: str = "text", lang_col: str = "lang", most: int = NUMBERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases by score, a and phrase.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and pieces into words at spaces and tabs.
    A phrase has 2 to 4 words and `least` occurrences or more (a). Of its cuts into a first part (l occurrences) and
    the rest (r) the one of the least score floor(2000000 * a / (l + r)) counts, ties to the shorter first part. A
    phrase inside a longer one that has `covered` % of its occurrences or more is dropped. n: words of the language.

    Null texts are empty, a null language is `und`, and a language that is spelled so joins it. Repeated rows count each
    time. Texts of any length are read in slices of whole pieces. Other columns don't matter. Without phrases, as in an
    empty table, there are no rows.
    """
    vocab = cut(vocabulary(docs, text_col, lang_col), "phrase-words")
    found = cut(frequent_phrases(docs, vocab, least, text_col, lang_col, most), "phrase-counts")
    one = vocab.where(F.col("n") >= least).select(F.array("h").alias("part"), F.col("n").alias("f"))
    counts = one.unionByName(found.where(F.size("c") < 4).select(F.col("c").alias("part"), F.col("a").alias("f")))
    cuts = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda k: F.array(F.struct(k.alias("k"), F.lit(0).alias("side"), F.slice("c", F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit(1).alias("side"), F.slice("c", k + 1, F.lit(3)).alias("part"))))
    parts = found.select("c", "a", F.explode(F.flatten(cuts)).alias("p")).select("c", "a", "p.*")
    met = parts.join(counts, "part")
    # a phrase inside a longer one is also inside one of one word more, which has no fewer occurrences than the longer one
    inside = (F.size("part") > 1) & (F.size("part") == F.size("c") - 1) & (100 * F.col("a").cast("decimal(20,0)") >= covered * F.col("f").cast("decimal(20,0)"))
    both = F.array(F.struct(F.col("c").alias("key"), "a", "k", "side", "f", F.lit(False).alias("gone")), F.when(inside, F.struct(F.col("part").alias("key"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("side"), F.lit(None).cast("long").alias("f"), F.lit(True).alias("gone"))))
    each = met.select(F.explode(both).alias("x")).where("x is not null").select("x.*")
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    whole = each.groupBy("key").agg(F.max("a").alias("a"), F.max("gone").alias("gone"), *(of(k, side).alias(f"{name}{k}") for k in (1, 2, 3) for side, name in ((0, "l"), (1, "r"))))
    score = lambda k: F.expr(f"(2000000 * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    least_of = F.array_min(F.array_compact(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in (1, 2, 3)))))
    scored = whole.where("not gone").select(F.col("key").alias("c"), "a", least_of.alias("s")).select("c", "a", "s.*")
    langs = vocab.where(F.col("n") >= least).select("lang", "word", "h")
    named = cut(scored.withColumn("h", F.element_at("c", 1)).join(langs.select("lang", "h"), "h").drop("h"), "phrase-scores")
    best = named.withColumn("_place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_place") <= top)
    best = best.select("lang", "c", "a", "l", "r", "score", F.posexplode("c").alias("at", "h"))
    spelled = best.join(langs.select("word", "h"), "h").groupBy("lang", "c", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    totals = vocab.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
