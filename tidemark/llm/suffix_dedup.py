"""Suffix-array deduplication: remove every byte of a long string that also starts anywhere else in the corpus.

Equal strings must meet in one suffix array, and no array may hold the corpus. So strings meet by a key that their
content gives: the least hash of the short grams in a string of ``length`` bytes. Consecutive starts of a text with
one key form a region, which holds the bytes of all strings that start there. A region whose key no other region has, and
has once itself, needs no array. Equal regions are folded into one with a count. Regions of the other keys are concatenated, in chunks
of whole keys, into texts whose suffix arrays are built by two-stage sorting: suffixes smaller than their successor are
sorted directly, the rest are induced by one scan over the buckets of first bytes. Neighbours in the array with a common
prefix of ``length`` bytes are repeats, which their bytes confirm. The regions of a key that are too many for one task
are split again: by the least hashes in the first and in the last quarter of each string, since a passage that makes a
key common is shorter than a string and leaves one of both ends to the text around it. What is still too much then has
strings of a few different texts in very many places; these fold string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable, durable_by, in_arrow, look_up, parts, sweep, text_or_empty, without_estimates

LENGTH = 400
#: Bytes of the strings that passages by words are looked for with; shorter passages, of very short words, are looked for one by one.
SHORT = 200
#: How often regions are split: by one key, by the keys of both ends, by the whole string.
LEVELS = 3
#: Bytes of the grams that give the keys.
GRAM = 32
#: Starts that a region has at most; a longer run of one key (periodic text) is cut.
REGION_STARTS = 4096
#: Bytes of text that a suffix array is built over, about; bytes of different regions of one key above which it is split.
ARRAY_BYTES, KEY_BYTES = 1 << 19, 1 << 21

_BASE = 0x9E3779B97F4A7C15
#: Joins two hashes; were it a power of the base, terms of overlapping strings would cancel out.
_JOIN = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_BYTE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Hashes of the strings of 1, 2, 4, ... ``longest`` bytes that start at each place where they fit."""
    out = {1: _BYTE_VALUES[data]}
    size, base = 1, _BASE
    while size < longest:
        half = out[size]
        out[2 * size] = half[:-size] * np.uint64(base) + half[size:] if len(half) > size else half[:0]
        size, base = 2 * size, base * base & _MASK
    return out


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, from least values of block ends and block beginnings."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = np.full(-(-n // width) * width, _MASK, dtype=np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _recurs(hashed: np.ndarray, least: np.ndarray, width: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How far the second place of the least hash at each region's beginning is from its first, or 0: only where there is one can two of the region's strings be equal."""
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    largest = ~least_in_window(~padded, width)  # of the keys of all windows that hold a gram
    places = np.flatnonzero(hashed == largest[: len(hashed)])
    low, high = np.searchsorted(places, begin), np.searchsorted(places, end + width - 1)
    count = high - low
    owner = np.repeat(np.arange(len(begin)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = places[low[owner] + nth]
    same = hashed[at] == least[begin[owner]]
    at, owner = at[same], owner[same]
    out = np.zeros(len(begin), dtype=np.int64)
    again = np.flatnonzero(owner[1:] == owner[:-1])
    again = again[::-1]  # so that the first two of a region are written last
    out[owner[again]] = at[again + 1] - at[again]
    return out


def _power_of_two(most: int) -> int:
    return 1 << (most.bit_length() - 1)


def _string_keys(data: np.ndarray, length: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The key of the string at each start; gram hashes, their least values and the number of grams in a window, which show recurrence."""
    gram = _power_of_two(min(GRAM, length) if level == 1 else max(1, min(GRAM, length // 8)))
    span = length if level == 1 else max(gram, length // 4)
    hashed = gram_hashes(data, gram)[gram]
    hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(_BASE)
    hashed ^= hashed >> np.uint64(29)
    least = least_in_window(hashed, span - gram + 1)
    if level == 1:
        return least, hashed, least, span - gram + 1
    begin, end = least[: max(0, len(data) - length + 1)], least[length - span :]
    return (begin * np.uint64(_BASE)) ^ (end + (begin >> np.uint64(7))), hashed, least, span - gram + 1


def find_regions(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, level: int = 1) -> tuple[np.ndarray, ...]:
    """Regions of concatenated texts that begin at ``offsets`` (with the end): text, first start in it, starts, key, and after how many bytes the key recurs inside, or 0.

    On the last level each start is a region of its own, with key 0: its content tells all.
    """
    first, last = offsets[:-1], offsets[1:] - length  # starts of each text
    some = np.flatnonzero(first <= last)
    if not len(some):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, np.int64))
    if level >= LEVELS:
        count = last[some] - first[some] + 1
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(some, count), at, np.ones(len(at), np.int64), np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    keys, hashed, least, width = _string_keys(data, length, level)
    change = np.empty(len(keys), dtype=bool)
    change[0] = True
    np.not_equal(keys[1:], keys[:-1], out=change[1:])
    change[first[some]] = True
    after = last[some] + 1
    change[after[after < len(keys)]] = True
    begin = np.flatnonzero(change)
    text = np.searchsorted(offsets, begin, side="right") - 1
    end = np.minimum(np.append(begin[1:], len(keys)), last[text] + 1)
    good = begin < end
    begin, end, text = begin[good], end[good], text[good]
    if len(begin) and (end - begin).max() > REGION_STARTS:
        pieces = -(-(end - begin) // REGION_STARTS)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, end, text = np.repeat(begin, pieces) + nth * REGION_STARTS, np.repeat(end, pieces), np.repeat(text, pieces)
        end = np.minimum(end, begin + REGION_STARTS)
    return text, begin - offsets[text], end - begin, keys[begin], _recurs(hashed, least, width, begin, end)


class SuffixArray:
    """The suffixes of a text in the order of their first ``depth`` bytes at least."""

    def __init__(self, data: np.ndarray, depth: int) -> None:
        self.n, self.depth = len(data), depth
        self.longest = 8
        while self.longest * 2 <= depth:
            self.longest *= 2
        padded = np.zeros(self.n + 2 * depth + 2 * self.longest + 16, dtype=np.uint8)
        padded[: self.n] = data
        self.data = padded
        words = padded.astype(np.uint64)
        for size in (1, 2, 4):
            words = (words[:-size] << np.uint64(8 * size)) | words[size:]
        self.words = words  # the next eight bytes as a number
        self.hashes = gram_hashes(padded, self.longest)
        self.order = self._induce(self._sort_directly())

    def _smaller_than_next(self) -> np.ndarray:
        """Whether each suffix is smaller than its successor; the last suffix is larger than the empty one."""
        step = self.data[1 : self.n + 1].astype(np.int16) - self.data[: self.n]
        step[self.n - 1] = -1
        places = np.where(step != 0, np.arange(self.n), self.n - 1)
        return step[np.minimum.accumulate(places[::-1])[::-1]] > 0

    def common_prefix(self, a: np.ndarray, b: np.ndarray, known: np.ndarray | int = 0) -> np.ndarray:
        """A multiple of 8 bytes, up to ``depth`` or a little more, that suffixes a and b share beyond ``known`` shared bytes."""
        same = np.zeros(len(a), dtype=np.int64) + known
        size = self.longest
        for _ in range(2):  # steps of the longest size may be needed twice
            same = self._advance(a, b, same, size)
        while size > 8:
            size //= 2
            same = self._advance(a, b, same, size)
        return same

    def share(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffixes a and b, each a once, have a common prefix of ``depth`` bytes: hashes say so and bytes confirm it."""
        same = self.common_prefix(a, b) >= 8 * (self.depth // 8)
        same[same] = self._equal_bytes(a[same], b[same])
        return same

    def _equal_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ``depth`` bytes at a and b are equal. Where the strings eight bytes on are a pair too, only the first eight need a look."""
        after = np.full(len(self.words), -1)
        after[a] = b
        chained = after[a + 8] == b + 8
        head = self.words[a] == self.words[b]
        ends = np.flatnonzero(~chained)
        good = self._compare(a[ends], b[ends])
        if good.all() and head[chained].all():
            return np.ones(len(a), dtype=bool)
        return self._compare(a, b)  # hashes were wrong somewhere

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        eights, rest = divmod(self.depth, 8)
        same = np.ones(len(a), dtype=bool)
        for k in range(eights):
            same &= self.words[a + 8 * k] == self.words[b + 8 * k]
        if rest:
            shift = np.uint64(8 * (8 - rest))
            same &= self.words[a + 8 * eights] >> shift == self.words[b + 8 * eights] >> shift
        return same

    def _advance(self, a: np.ndarray, b: np.ndarray, same: np.ndarray, size: int) -> np.ndarray:
        at = np.minimum(same, self.depth)
        h = self.hashes[size]
        return same + size * ((h[a + at] == h[b + at]) & (same < self.depth))

    def _sort_directly(self) -> np.ndarray:
        """Suffixes smaller than their successor, sorted. Those with equal ``depth`` bytes are sorted as one."""
        self.direct = self._smaller_than_next()
        places = np.flatnonzero(self.direct)
        if not len(places):
            return places
        h = self.hashes[self.longest]  # of the first and of the last bytes of the depth, which overlap
        whole = h[places] * np.uint64(_JOIN) + h[places + self.depth - self.longest] if self.depth >= self.longest else h[places]
        order = np.argsort(whole, kind="stable")
        first = np.flatnonzero(np.append(True, whole[order[1:]] != whole[order[:-1]]))
        count = np.diff(np.append(first, len(order)))
        one = places[order[first]]
        at = np.empty(self.n, dtype=np.int64)
        at[one] = np.arange(len(one))
        rank = at[self._sort_different(one)]
        begin = np.cumsum(count[rank]) - count[rank]
        nth = np.arange(len(places)) - np.repeat(begin, count[rank])
        return places[order[np.repeat(first[rank], count[rank]) + nth]]

    def _sort_different(self, places: np.ndarray) -> np.ndarray:
        """Suffixes sorted by eight bytes, then groups of equals by the next eight after what all members share."""
        places = places[np.argsort(self.words[places], kind="stable")]
        words = self.words[places]
        group = np.cumsum(np.append(True, words[1:] != words[:-1])) - 1
        slots, depth = np.arange(len(places)), np.full(len(places), 8)
        while True:
            pair = np.flatnonzero(group[1:] == group[:-1])
            if not len(pair):
                return places
            at = places[slots]
            shared = self.common_prefix(at[pair], at[pair + 1], depth[pair])
            first = np.flatnonzero(np.append(True, group[pair][1:] != group[pair][:-1]))
            least = np.minimum.reduceat(shared, first)
            open_groups = least < self.depth
            if not open_groups.any():
                return places
            which = np.full(group[-1] + 1, -1)
            which[group[pair[first[open_groups]]]] = np.flatnonzero(open_groups)
            member = which[group] >= 0
            slots, at, owner = slots[member], at[member], which[group[member]]
            depth = least[owner]
            words = self.words[at + depth]
            order = np.lexsort((words, owner))
            at, words, owner, depth = at[order], words[order], owner[order], depth[order] + 8
            places[slots] = at
            group = np.cumsum(np.append(True, (owner[1:] != owner[:-1]) | (words[1:] != words[:-1]))) - 1

    def _induce(self, sorted_directly: np.ndarray) -> np.ndarray:
        """Put each suffix larger than its successor behind those already in the bucket of its first byte, in one scan over all buckets."""
        first_bytes = self.data[sorted_directly]
        edges = np.searchsorted(first_bytes, np.arange(257))
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        if self.n:
            waiting[self.data[self.n - 1]].append(np.array([self.n - 1]))  # induced by the empty suffix
        out = []
        for c in range(256):
            held, wave = waiting[c], np.concatenate([*waiting[c], np.empty(0, np.int64)])
            while len(wave):  # suffixes that begin with a run of the byte induce others in the same bucket
                before = wave[wave > 0] - 1
                wave = before[(self.data[before] == c) & ~self.direct[before]]
                if len(wave):
                    held.append(wave)
            bucket = np.concatenate([*held, sorted_directly[edges[c] : edges[c + 1]]]).astype(np.int64)
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[~self.direct[before] & (self.data[before] > c)]
            if len(before):
                byte = self.data[before]
                order = np.argsort(byte, kind="stable")
                before, byte = before[order], byte[order]
                cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
                for piece in np.split(before, cuts):
                    waiting[self.data[piece[0]]].append(piece)
        return np.concatenate(out)


def repeated_starts(regions: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each region, which of its starts have a string that another start of the regions has too."""
    sizes = np.array([len(r) for r in regions])
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(regions), dtype=np.uint8)
    array = SuffixArray(data, length)
    mark = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(mark, begin + sizes - length + 1, 1)
    np.add.at(mark, begin + sizes, -1)
    owned = np.cumsum(mark[:-1]) == 0  # the last length - 1 bytes of a region start no string of it
    order = array.order[owned[array.order]]
    same = array.share(order[:-1], order[1:])
    repeated = np.zeros(len(data), dtype=bool)
    repeated[order[:-1][same]] = True
    repeated[order[1:][same]] = True
    return [repeated[b : b + s - length + 1] for b, s in zip(begin, sizes, strict=True)]


def covered_spans(starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """First and last-plus-one bytes covered by strings at the sorted ``starts``, in maximal runs, as an n x 2 array."""
    if not len(starts):
        return np.empty((0, 2), dtype=np.int64)
    gaps = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return np.stack([np.append(starts[0], starts[gaps + 1]), np.append(starts[gaps], starts[-1]) + length], axis=1)


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Spans sorted and joined where they overlap or touch."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[new, 0], reach[np.append(new[1:], len(spans)) - 1]], axis=1)


#: A region as it is kept, where a row of its own would have over 100 bytes: ``size`` bytes of a text, told by ``length`` of them.
_REGION = np.dtype([("key", "<i8"), ("content", "V16"), ("first", "<u4"), ("size", "<u4"), ("length", "<u4"), ("recurs", "?"), ("twice", "?")])


def _periodic(joined: bytes, begin: int, size: int, starts: int, period: int) -> bool:
    """Whether a region goes on after ``period`` bytes as it began, for so long that each of its strings is there twice."""
    return 0 < 2 * period <= starts and joined[begin : begin + size - period] == joined[begin + period : begin + size]


def _packed_regions(texts: DataFrame, length: int, level: int) -> DataFrame:
    """uid, n and packed: where the regions of each text lie and a 128-bit hash of their bytes.

    All strings of a periodic region repeat inside it, and one period of them is all there are: it is told by its
    beginning and counts twice, and no array is needed to find its repeats.
    """

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, rows = b["raw"], b.select(["uid", "n"])
            k = 0
            while k < b.num_rows:
                held, first, weight = [], k, 0
                while k < b.num_rows and (not held or weight < 1 << 20):
                    held.append(raw[k].as_py())
                    weight += len(held[-1])
                    k += 1
                joined = b"".join(held)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in held])])
                found = find_regions(np.frombuffer(joined, dtype=np.uint8), offsets, length, level)
                for at in range(0, len(found[0]), 1 << 18):
                    text, start, starts, keys, recurs = (x[at : at + (1 << 18)] for x in found)
                    begin, size = offsets[text] + start, starts + length - 1
                    told, twice = size.copy(), np.zeros(len(text), bool)
                    for x in np.flatnonzero((recurs > 0) & (2 * recurs <= starts)).tolist():
                        if _periodic(joined, int(begin[x]), int(size[x]), int(starts[x]), int(recurs[x])):
                            told[x], twice[x] = recurs[x] + length - 1, True
                    view = memoryview(joined)
                    content = b"".join(hashlib.blake2b(view[x : x + s], digest_size=16).digest() for x, s in zip(begin.tolist(), told.tolist(), strict=True))
                    packed = np.empty(len(text), dtype=_REGION)
                    packed["key"] = np.frombuffer(content, dtype="<i8")[::2] if level >= LEVELS else keys.view(np.int64)
                    packed["content"], packed["first"], packed["size"], packed["length"] = np.frombuffer(content, dtype="V16"), start, size, told
                    packed["recurs"], packed["twice"] = (recurs > 0) & ~twice, twice
                    edges = np.append(np.flatnonzero(np.append(True, text[1:] != text[:-1])), len(text))
                    owner = rows.take(pa.array(text[edges[:-1]] + first))
                    pieces = [packed[x:y].tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([owner["uid"], owner["n"], pa.array(pieces, pa.binary())], ["uid", "n", "packed"])

    return in_arrow(texts.select("uid", "n", "raw"), regions, "uid binary, n long, packed binary")


def _regions(packed: DataFrame, keys_only: bool = False) -> DataFrame:
    """n, key and recurs of each packed region, or all of it: uid, n, key, content, first, size, length, recurs."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.frombuffer(x.as_py(), dtype=_REGION) for x in b["packed"]]
            if not held:
                continue
            rows, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
            n = pa.array(np.asarray(b["n"])[owner] * (1 + rows["twice"]))
            key, recurs = pa.array(np.ascontiguousarray(rows["key"])), pa.array(np.ascontiguousarray(rows["recurs"]))
            if keys_only:
                yield pa.RecordBatch.from_arrays([n, key, recurs], ["n", "key", "recurs"])
                continue
            content = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows["content"]).tobytes())]).cast(pa.binary())
            numbers = (pa.array(rows[c].astype(np.int64)) for c in ("first", "size", "length"))
            yield pa.RecordBatch.from_arrays([b["uid"].take(pa.array(owner)), n, key, content, *numbers, recurs], ["uid", "n", "key", "content", "first", "size", "length", "recurs"])

    if keys_only:
        return in_arrow(packed, unpack, "n long, key long, recurs boolean")
    return in_arrow(packed, unpack, "uid binary, n long, key long, content binary, first long, size long, length long, recurs boolean")


def _spans_by_suffix_array(regions: DataFrame, length: int) -> DataFrame:
    """content and spans of regions that share strings; ``regions`` has key, content, bytes, rows of a key adjacent."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple[bytes, bytes]] = []
        weight, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for (content, _), which in zip(some, repeated_starts([x for _, x in some], length), strict=True):
                if which.any():
                    rows.append((content, covered_spans(np.flatnonzero(which), length).astype("<i4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["content", "spans"])

        for b in batches:
            for key, content, raw in zip(b["key"].to_pylist(), b["content"].to_pylist(), b["bytes"], strict=True):
                if key != last and weight >= ARRAY_BYTES:
                    yield from flush()
                    some, weight = [], 0
                last = key
                some.append((content, raw.as_py()))
                weight += len(some[-1][1])
        if some:
            yield from flush()

    return in_arrow(regions.select("key", "content", "bytes"), sort, "content binary, spans binary")


def _spans_of_split(regions: DataFrame, length: int, level: int) -> DataFrame:
    """content and spans of regions whose key is too common: each is taken as a text, and its strings meet by keys of the next level."""
    texts = regions.select(F.col("content").alias("uid"), "n", F.col("bytes").alias("raw"))
    return _merged(_found(without_estimates(texts), length, level)).withColumnRenamed("uid", "content")


def _merged(found: DataFrame) -> DataFrame:
    """uid and spans: the runs of bytes to remove of each text, four bytes a number."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_removed(x).astype("<i4").tobytes() for x in b["found"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["uid"], pa.array(spans, pa.binary())], ["uid", "spans"])

    return in_arrow(found, merge, "uid binary, spans binary")


def _numbers(spans: bytes | None) -> np.ndarray:
    return np.frombuffer(spans or b"", dtype="<i4").reshape(-1, 2).astype(np.int64)


def _found(texts: DataFrame, length: int, level: int = 1) -> DataFrame:
    """uid and found, a list of (first, size, spans) of the regions that hold repeats; ``texts`` has uid, n (how often it stands for its bytes) and raw.

    Regions of a key that no other region has, most of them, go first; only the others travel with their contents.
    """
    spark = texts.sparkSession
    packed = durable(_packed_regions(texts, length, level))
    times = _regions(packed, keys_only=True).groupBy("key").agg(F.sum("n").alias("times"), F.max("recurs").alias("recurs"))
    times = durable(times.filter("times > 1 OR recurs").select("key", "times"))
    total = times.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    regions = durable(look_up(_regions(packed), times, "key", "times", total).filter("times IS NOT NULL"))
    folded = durable(regions.groupBy("key", "content").agg(F.sum("n").alias("n"), F.min(F.struct("uid", "first")).alias("one"), F.max("length").alias("length"), F.max("recurs").alias("recurs")))
    keys = folded.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.sum("length").alias("key_bytes"), F.max("recurs").alias("recurs"))
    keys = durable(keys.filter("different > 1 OR recurs").select("key", "different", "key_bytes"))
    total, largest = keys.agg(F.coalesce(F.sum("different"), F.lit(0)), F.coalesce(F.max("key_bytes"), F.lit(0))).first()
    shared = look_up(folded, keys, "key", "different", total).filter("different IS NOT NULL")
    wanted = shared.groupBy(F.col("one.uid").alias("uid")).agg(F.collect_list(F.struct("key", "content", "n", "key_bytes", F.col("one.first").alias("first"), "length")).alias("wanted"))
    cut = F.transform("wanted", lambda r: F.struct(r["key"].alias("key"), r["content"].alias("content"), r["n"].alias("n"), r["key_bytes"].alias("key_bytes"), F.substring(F.col("raw"), (r["first"] + 1).cast("int"), r["length"].cast("int")).alias("bytes")))
    cut = durable(texts.select("uid", "raw").join(wanted, "uid").select(F.explode(cut).alias("r")).select("r.*"))
    if level == 1:
        sweep(spark)
    split = level < LEVELS and largest > KEY_BYTES
    small = cut.filter(F.col("key_bytes") <= KEY_BYTES) if split else cut
    small = small.repartition(parts(spark), "key").sortWithinPartitions("key", "content")
    shared_spans = _spans_by_suffix_array(small, length)
    if split:
        large = cut.filter(F.col("key_bytes") > KEY_BYTES)
        shared_spans = shared_spans.unionByName(_spans_of_split(large, length, level + 1))
    # A region that occurs twice is a repeat from its first byte to its last.
    whole = folded.filter("n > 1").select("content", "n")
    spans = folded.select("content", "n").join(shared_spans, "content").filter("n = 1").unionByName(whole.withColumn("spans", F.lit(None).cast("binary")))
    spans = durable(spans.select("content", "n", F.coalesce("spans", F.lit(b"")).alias("spans")))
    total = spans.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = look_up(regions.select("uid", "content", "first", "size"), spans, "content", "n", total).filter("n IS NOT NULL")
    return found.groupBy("uid").agg(F.collect_set(F.struct("first", "size", "spans")).alias("found"))


def _removed(found: list[dict] | None) -> np.ndarray:
    """The spans to remove of a text; no spans of a region means all of it."""
    if not found:
        return np.empty((0, 2), dtype=np.int64)
    pieces = []
    for r in found:
        spans = np.frombuffer(r["spans"], dtype="<i4").reshape(-1, 2).astype(np.int64)
        pieces.append((spans if len(spans) else np.array([[0, r["size"]]])) + r["first"])
    return merged_spans(np.concatenate(pieces))


def _kept(raw: bytes, spans: np.ndarray) -> list[memoryview]:
    view, at, out = memoryview(raw), 0, []
    for first, last in spans.tolist():
        out.append(view[at:first])
        at = last
    return [*out, view[at:]]


def _uid() -> Column:
    """What rows with one text have in common; they are one another's repeats and fare alike."""
    return F.unhex(F.sha2(text_or_empty().cast("binary"), 256))


def _texts(docs: DataFrame) -> DataFrame:
    """uid, n and raw of the different texts of ``docs``, folded map-side, and dealt out by uid for all that follows."""
    rows = docs.select(_uid().alias("uid"), text_or_empty().cast("binary").alias("raw"))
    texts = durable_by(rows.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw")), "uid")
    sweep(docs.sparkSession)
    return texts


def _long_runs(marked: DataFrame, length: int) -> DataFrame:
    """The repeated runs of at least ``length`` bytes as texts of their own: uid (with the place of the run), n and raw.

    A string of ``length`` bytes that repeats lies in such a run, as all shorter strings in it repeat too.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for uid, n, raw, spans in zip(b["uid"], b["n"], b["raw"], b["spans"], strict=True):
                long = [(x, y) for x, y in _numbers(spans.as_py()).tolist() if y - x >= length]
                text = raw.as_py() if long else b""
                rows += [(uid.as_py() + x.to_bytes(8, "big"), n.as_py(), text[x:y]) for x, y in long]
            if rows:
                kinds = [pa.binary(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["uid", "n", "raw"])

    return durable_by(in_arrow(marked.filter("spans IS NOT NULL").select("uid", "n", "raw", "spans"), runs, "uid binary, n long, raw binary"), "uid")


def _in_texts(found: DataFrame) -> DataFrame:
    """uid and spans, the bytes to remove of each text, from what was found in its runs."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(x[:-8], (_removed(f) + int.from_bytes(x[-8:], "big")).astype("<i4").tobytes()) for x, f in zip(b["uid"].to_pylist(), b["found"].to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["uid", "spans"])

    return in_arrow(found, place, "uid binary, spans binary")


def word_windows(raw: bytes, words: int) -> np.ndarray:
    """First and last-plus-one bytes of every ``words`` consecutive words, which white space separates, as an n x 2 array."""
    data = np.frombuffer(raw, np.uint8)
    letter = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    return np.stack([edges[::2][: max(0, len(edges) // 2 - words + 1)], edges[1::2][words - 1 :]], axis=1)


def _windows(marked: DataFrame, words: int, short: int) -> DataFrame:
    """uid, n, first, last and hash (128 bits of the bytes) of the strings of ``words`` words that may repeat.

    One of at least ``short`` bytes can repeat only inside a run of repeated strings of ``short`` bytes; shorter ones all may.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, n, raw, found in zip(b["uid"], b["n"], b["raw"], b["spans"], strict=True):
                text, runs = raw.as_py(), _numbers(found.as_py())
                spans = word_windows(text, words)
                at = np.searchsorted(runs[:, 0], spans[:, 0], "right") - 1
                inside = (runs[at, 1] >= spans[:, 1]) & (at >= 0) if len(runs) else np.zeros(len(spans), bool)
                spans = spans[inside | (spans[:, 1] - spans[:, 0] < short)]
                view = memoryview(text)
                for k in range(0, len(spans), 1 << 15):
                    some = spans[k : k + (1 << 15)]
                    told = [hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in some.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.repeat(uid, len(some)), pa.repeat(n, len(some)), pa.array(some[:, 0]), pa.array(some[:, 1]), pa.array(told, pa.binary())], ["uid", "n", "first", "last", "hash"])

    return durable(in_arrow(marked.select("uid", "n", "raw", "spans"), windows, "uid binary, n long, first long, last long, hash binary"))


def _passages(windows: DataFrame) -> DataFrame:
    """uid and spans: the strings of words that start anywhere else, too, joined where they overlap.

    A longer passage that repeats is the union of such strings, so each match is judged by its own words, never by runs
    that matches of different places form together. Strings fold by their hash, map-side.
    """
    again = durable(windows.groupBy("hash").agg(F.sum("n").alias("times")).filter("times > 1"))
    total = again.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    known = look_up(windows.select("uid", "first", "last", "hash"), again, "hash", "times", total).filter("times IS NOT NULL")
    of_texts = known.groupBy("uid").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [merged_spans(np.stack([x.values.to_numpy(), y.values.to_numpy()], axis=1)).astype("<i4").tobytes() for x, y in zip(b["first"], b["last"], strict=True)]
            yield pa.RecordBatch.from_arrays([b["uid"], pa.array(spans, pa.binary())], ["uid", "spans"])

    return in_arrow(of_texts, join, "uid binary, spans binary")


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    Every byte of a ``length``-byte string that starts at two places, in one text or two, counts as removed; strings
    are judged on the input. Null text is empty, texts below ``length`` bytes lose nothing, and rows that repeat a text,
    with whatever ids, repeat all its strings. An empty table gives an empty result; columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    texts = _texts(docs)
    both = texts.join(_found(texts, length), "uid", "left")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, found in zip(b["raw"], b["found"], strict=True):
                text, spans = raw.as_py(), _removed(found.as_py())
                digest = hashlib.sha256()
                for piece in _kept(text, spans):
                    digest.update(piece)
                rows.append((len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest()))
            if rows:
                cols = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([b["uid"], b["n"], *cols], ["uid", "n", *measures])

    measures = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    per_text = durable(in_arrow(both.select("uid", "n", "raw", "found"), measure, "uid binary, n long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    sweep(docs.sparkSession)
    total = per_text.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return look_up(docs.select("doc_id", _uid().alias("uid")), per_text, "uid", "n", total).select("doc_id", *measures)


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, words: int | None = None, short: int = SHORT) -> DataFrame:
    """``docs`` with repeated bytes taken out of text; a character that loses some of its bytes goes as a whole.

    Every ``length``-byte string that starts anywhere else goes. With ``words``, so does every string of that many
    whole words, separated by white space, that starts anywhere else, whatever its bytes; a match of fewer words and
    bytes stays even where it touches another. Null text stays null, repeated rows lose the same, an empty table stays
    empty, and other columns pass through, whatever their names.
    """
    columns = docs.columns
    texts = _texts(docs)
    if words is None:
        spans = _merged(_found(texts, length))
    else:
        runs = without_estimates(durable(_merged(_found(texts, short))))  # texts stay where they are
        sweep(docs.sparkSession)
        with_runs = texts.join(runs, "uid")
        brief = _windows(texts.join(runs, "uid", "left"), words, short)
        spans = _passages(brief).unionByName(_in_texts(_found(_long_runs(with_runs, length), length)))
    marked = texts.join(spans.groupBy("uid").agg(F.collect_list("spans").alias("removed")), "uid", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for raw, removed in zip(b["raw"], b["removed"], strict=True):
                gone = merged_spans(np.concatenate([_numbers(x) for x in removed.as_py() or [b""]]))
                made.append(b"".join(_kept(raw.as_py(), gone)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b["uid"], pa.array(made, pa.string())], ["__uid", "__kept"])

    kept = in_arrow(marked.select("uid", "raw", "removed"), cut, "__uid binary, __kept string")
    rows = docs.withColumns({"__uid": _uid(), "__null": F.col("text").isNull()}).drop("text")
    out = rows.join(kept, "__uid").withColumn("text", F.when(~F.col("__null"), F.col("__kept")))
    return out.select(*(F.col(f"`{c}`") for c in columns))
