"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles, banded and verified, and MinHash over their counts.

A text is the multiset of its shingles, five words each. A shingle weighs its count in the text times its inverse
document frequency, 1 + ln((1 + N) / (1 + df)), where df is the exact number of different texts with the shingle's 56-bit hash.
Packs of texts send their different hashes to ranges of hashes as arrays; each range adds up the counts and answers each
pack, so a frequent shingle is one number of each pack and no row. Texts whose samples agree in a band are candidates,
and candidates are linked if their weighted Jaccard similarity is at least the threshold.

The more copies a text has, the more frequent are the shingles that they share, and the less these weigh beside the few
that each copy has alone. So in large groups of copies TF-IDF alone would tell copies apart, and the more the larger the
group is. Counts don't depend on other texts: they have bands of their own, and a pair whose weighted Jaccard similarity
by counts is at least the threshold is linked as well.

Buckets are never expanded into rows of pairs. First each text is compared with one leader of its buckets. Components of
those links then leave texts that are apart from others in a bucket; these are compared with the others in blocks of
bounded size, inside the task: the vectors of every pair, those with the most agreeing samples first, but of no pair that
links of the block already connect. Only links leave a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, follow
from .durable import durable, look_up, parts, row_key, rows_with_keys, ship, sweep, text_or_empty, worker_state


@dataclass(frozen=True)
class NearConfig:
    """Words of a shingle, similarity of a link, bands by TF-IDF, bands by counts and samples of a band, bits of a :class:`Frequencies` sketch (not used by the query), and texts of a block."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 14
    count_bands: int = 14
    band_samples: int = 4
    sketch_bits: int = 18
    block: int = 256

    @property
    def samples(self) -> int:
        return (self.bands + self.count_bands) * self.band_samples


_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of text that are hashed at once.
BATCH_BYTES = 1 << 20
#: Bytes of text in a pack, and shingles of a range of hashes at most, about.
PACK_BYTES = 8 << 20
RANGE_SHINGLES = 1 << 21

def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least n places."""
    size, tables = max(1 << 21, 1 << (n - 1).bit_length()), worker_state("near dedup")
    if size not in tables:
        tables.clear()
        out = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        tables[size] = tuple(out)
    return tables[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(_GOLD)
    x = (x ^ (x >> _U(29))) * _U(_BASE)
    return x ^ (x >> _U(32))


def shingles(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted 56-bit hashes of each text's shingles, one for each occurrence.

    A word is a run of ASCII letters and digits and of characters beyond ASCII, in lower case. A text of fewer words than
    a shingle has is one shingle, and a text without words has none.
    """
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*encoded, b""]), dtype=np.uint8)
    ends = np.cumsum([len(e) + 1 for e in encoded])
    inside = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[0::2], edge[1::2]  # the data end outside a word
    power, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[: len(data)], dtype=np.uint64)])
    word = _mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])
    state = np.zeros(max(len(word) - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        state = state * _U(_BASE) + word[k : k + len(state)]
    hashed = _mix(state) >> _U(8)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.sort(hashed[a : b - words + 1]))
        elif b > a:
            short = 0
            for w in word[a:b].tolist():
                short = (short * _BASE + w) & _MASK
            out.append(_mix(np.array([short ^ b - a], dtype=np.uint64)) >> _U(8))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _sketch_cells(shingle: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    wide = shingle.astype(np.uint64)
    return tuple((((wide + _U(k + 1)) * _U(m)) >> _U(64 - bits)).astype(np.int64) for k, m in enumerate((_GOLD, _BASE)))


@dataclass
class Frequencies:
    """A count-min sketch of document frequencies, ``texts`` and two rows of counts, to weigh small sets without a job."""

    texts: int
    rows: np.ndarray
    bits: int

    def weights(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        a, b = _sketch_cells(shingle, self.bits)
        df = np.minimum(self.rows[0][a], self.rows[1][b])
        return count * (1 + np.log((1 + self.texts) / (1 + df)))


def _packs(docs: DataFrame) -> DataFrame:
    """pack (the rid of its first text), rids, sizes and texts (UTF-8, compressed) of packs of different texts with words."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, texts, held = [], [], 0

        def row() -> pa.RecordBatch:
            blob = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([rids[0]], pa.binary()), pa.array([b"".join(rids)], pa.binary()), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["pack", "rids", "sizes", "texts"])

        for b in batches:
            for rid, text in zip(b["rid"].to_pylist(), b["text"].to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if not _WORD[np.frombuffer(data, dtype=np.uint8)].any():
                    continue
                rids.append(rid)
                texts.append(data)
                held += len(texts[-1])
                if held >= PACK_BYTES:
                    yield row()
                    rids, texts, held = [], [], 0
        if rids:
            yield row()

    return docs.select("rid", "text").dropDuplicates(["rid"]).mapInArrow(gather, "pack binary, rids binary, sizes array<long>, texts binary")


def _pack_vectors(sizes: list[int], texts: pa.Scalar, words: int) -> list[np.ndarray]:
    """The shingles of each text of a pack."""
    data, out, at, k = memoryview(pa.decompress(texts.as_buffer(), sum(sizes), codec="zstd")), [], 0, 0
    while k < len(sizes):
        some, held = [], 0
        while k < len(sizes) and held < BATCH_BYTES:
            some.append(str(data[at : at + sizes[k]], "utf-8", "surrogatepass"))
            at, held, k = at + sizes[k], held + sizes[k], k + 1
        out += shingles(some, words)
    return out


def _once(vectors: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The different shingles of each sorted vector, and how often each occurs in it."""
    both = [np.unique(v, return_counts=True) for v in vectors]
    return [x for x, _ in both], [n for _, n in both]


def document_frequencies(packs: DataFrame, config: NearConfig, ranges: int) -> DataFrame:
    """pack and found: the number of texts with each of the pack's different shingles, in their order, as pieces by range."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, sizes, texts in zip(b["pack"].to_pylist(), b["sizes"].to_pylist(), b["texts"], strict=True):
                own, _ = _once(_pack_vectors(sizes, texts, config.words))
                shingle, count = np.unique(np.concatenate(own), return_counts=True)
                to = ((shingle >> _U(24)) * _U(ranges)) >> _U(32)
                cuts = np.searchsorted(to, np.arange(ranges + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[k], cuts[k + 1])
                    # Seven bytes of a hash, plane by plane: the planes of high bytes compress.
                    planes = shingle[part].view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()
                    row = [pa.array([k], pa.int32()), pa.array([pack], pa.binary()), pa.array([planes], pa.binary()), pa.array([zlib.compress(count[part].astype(np.int64).tobytes(), 1)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, ["range", "pack", "shingles", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def answers() -> Iterator[pa.RecordBatch]:
            shingle, at = np.unique(np.concatenate([x for _, x, _ in held]), return_inverse=True)
            df = np.zeros(len(shingle), dtype=np.int64)
            np.add.at(df, at, np.concatenate([n for _, _, n in held]))
            df, begin = df[at], 0
            for pack, x, _ in held:
                yield pa.RecordBatch.from_arrays([pa.array([pack], pa.binary()), pa.array([now], pa.int32()), pa.array([zlib.compress(df[begin : begin + len(x)].tobytes(), 1)], pa.binary())], ["pack", "range", "df"])
                begin += len(x)

        for b in batches:
            for k, pack, planes, counts in zip(*(b[c].to_pylist() for c in ("range", "pack", "shingles", "counts")), strict=True):
                if k != now:
                    if held:
                        yield from answers()
                    now, held = k, []
                whole = np.zeros((len(planes) // 7, 8), dtype=np.uint8)
                whole[:, :7] = np.frombuffer(planes, dtype=np.uint8).reshape(7, -1).T
                held.append((pack, whole.view(np.uint64).ravel(), np.frombuffer(zlib.decompress(counts), dtype=np.int64)))
        if held:
            yield from answers()

    asked = packs.select("pack", "sizes", "texts").mapInArrow(ask, "range int, pack binary, shingles binary, counts binary")
    answered = asked.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(add, "pack binary, range int, df binary")
    return answered.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("range", "df")))["df"].alias("found"))


Weighed = tuple[np.ndarray, np.ndarray, float]


def packed(shingle: np.ndarray, weights: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """A text's different shingles, their weights and their counts (1 by default) as bytes. To compare texts, 32 bits of a hash are kept."""
    short = (shingle >> _U(24)).astype(np.uint32)
    first = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
    counts = np.add.reduceat(np.ones(len(short), np.int64) if counts is None else counts, first)
    tail = b"" if (counts == 1).all() else zlib.compress(counts.astype(np.uint32).tobytes(), 1)
    return np.uint32(len(first)).tobytes() + short[first].tobytes() + zlib.compress(np.add.reduceat(weights, first).tobytes(), 1) + tail


def opened_both(data: bytes | pa.Buffer) -> tuple[Weighed, Weighed]:
    """The shingles that :func:`packed` was given by their weights, and by their counts, each with its sum."""
    data = memoryview(data)
    end = 4 + 4 * int(np.frombuffer(data[:4], dtype=np.uint32)[0])
    shingle, inflate = np.frombuffer(data[4:end], dtype=np.uint32), zlib.decompressobj()
    weights = np.frombuffer(inflate.decompress(data[end:]), dtype=np.float64)
    tail = inflate.unused_data
    counts = np.frombuffer(zlib.decompress(tail), dtype=np.uint32).astype(np.float64) if tail else np.ones(len(shingle))
    return (shingle, weights, float(weights.sum())), (shingle, counts, float(counts.sum()))


def opened(data: bytes | pa.Buffer) -> Weighed:
    """The shingles and weights that :func:`packed` was given, and the sum of the weights."""
    return opened_both(data)[0]


def weights_of(packs: DataFrame, found: DataFrame, texts: int, config: NearConfig) -> DataFrame:
    """rid and vector (see :func:`packed`) of each of the ``texts`` texts in packs."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rids, sizes, blob, pieces in zip(b["rids"].to_pylist(), b["sizes"].to_pylist(), b["texts"], b["found"].to_pylist(), strict=True):
                own, counts = _once(_pack_vectors(sizes, blob, config.words))
                joined = np.concatenate(own)
                df = np.concatenate([np.frombuffer(zlib.decompress(x), dtype=np.int64) for x in pieces])
                weights = np.concatenate(counts) * (1 + np.log((1 + texts) / (1 + df[np.unique(joined, return_inverse=True)[1]])))
                ends = np.cumsum([len(x) for x in own]).tolist()
                rows = [(rids[16 * k : 16 * k + 16], packed(x, weights[end - len(x) : end], n)) for k, (x, n, end) in enumerate(zip(own, counts, ends, strict=True))]
                for k in range(0, len(rows), 256):
                    some = rows[k : k + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.binary()), pa.array([x for _, x in some], pa.binary())], ["rid", "vector"])

    return packs.join(found, "pack").select("rids", "sizes", "texts", "found").mapInArrow(weigh, "rid binary, vector binary")


#: Shingles whose draws are made at once, so that they stay in a core's cache.
_AT_ONCE = 1 << 14


def _draws(samples: int) -> np.ndarray:
    """A 64-bit seed for each sample; a shingle's draws for the sample are hashes of both."""
    return np.random.default_rng(20100417).integers(0, 1 << 64, samples, dtype=np.uint64)


def _unit(bits: np.ndarray, n: int) -> np.ndarray:
    """Numbers in (0, 1) from the lowest n <= 23 bits."""
    return ((bits & _U((1 << n) - 1)).astype(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-n)


def _drawn(wide: np.ndarray, log_weight: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """t and ln a of each shingle for the sample of a seed."""
    one = _mix(wide ^ seed)
    two = _mix(one + _U(_GOLD))
    r = -np.log(_unit(one, 21) * _unit(one >> _U(21), 21))
    beta = _unit(one >> _U(42), 22)
    log_c = np.log(-np.log(_unit(two, 23)) - np.log(_unit(two >> _U(23), 23)))
    t = np.floor(log_weight / r + beta)
    return t, log_c - r * (t - beta + np.float32(1))


def signatures(vectors: list[np.ndarray], known: Frequencies, draws: np.ndarray) -> np.ndarray:
    """The samples (rows: texts, columns: samples) as 64-bit hashes of the shingle and its quantised weight.

    A sample of a weighted set is the shingle with the least a = c exp(-r (t - beta + 1)), t = floor(ln w / r + beta), with
    r, c ~ Gamma(2, 1) and beta ~ U(0, 1) drawn for every shingle; two sets agree in it with the probability of their weighted Jaccard similarity.
    Vectors must be sorted and not empty: the first of equal values counts.
    """
    joined = np.concatenate(vectors)
    sizes = np.array([len(v) for v in vectors])
    begin = np.cumsum(sizes) - sizes
    new = np.append(True, joined[1:] != joined[:-1])
    new[begin] = True
    places = np.flatnonzero(new)
    count = np.diff(np.append(places, len(joined)))
    shingle = joined[places]
    begin = np.searchsorted(places, begin)
    return samples(shingle, known.weights(shingle, count), begin, draws)


def samples(shingle: np.ndarray, weights: np.ndarray, begin: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """:func:`signatures` of texts whose different shingles and weights are joined; ``begin`` has the place of each first one."""
    sizes = np.diff(np.append(begin, len(shingle)))
    log_weight = np.log(weights).astype(np.float32)
    wide = _mix(shingle.astype(np.uint64))
    out = np.empty((len(begin), len(draws)), dtype=np.uint64)
    t, log_a = np.empty_like(log_weight), np.empty_like(log_weight)
    for k in range(len(draws)):
        for at in range(0, len(wide), _AT_ONCE):
            part = slice(at, at + _AT_ONCE)
            t[part], log_a[part] = _drawn(wide[part], log_weight[part], draws[k])
        least = np.minimum.reduceat(log_a, begin)
        hits = np.flatnonzero(log_a == np.repeat(least, sizes))
        best = hits[np.searchsorted(hits, begin)]
        out[:, k] = _mix(wide[best] ^ (t[best].astype(np.int64).view(np.uint64) * _U(_GOLD)))
    return out


def count_samples(shingle: np.ndarray, counts: np.ndarray, begin: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Like :func:`samples`, of counts: a sample is the least hash of a shingle's first, second, ... occurrence, so two texts agree in it with the probability of their weighted Jaccard similarity by counts."""
    times = counts.astype(np.int64)
    ends = np.cumsum(times)
    nth = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - times, times)
    wide = _mix(np.repeat(shingle.astype(np.uint64), times) + nth.astype(np.uint64) * _U(_GOLD))
    begin = (ends - times)[begin]
    sizes = np.diff(np.append(begin, len(wide)))
    out = np.full((len(begin), len(draws)), ~_U(0), dtype=np.uint64)
    # Texts are told apart by where they begin, so a part of all occurrences can hold some of them, whole.
    cuts = [0]
    while cuts[-1] < len(begin):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begin, begin[cuts[-1]] + _AT_ONCE))))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first, last = int(begin[a]), int(begin[b - 1] + sizes[b - 1])
        for k in range(len(draws)):
            out[a:b, k] = np.minimum.reduceat((wide[first:last] ^ draws[k]) * _U(_BASE), begin[a:b] - first)
    return _mix(out)


def weighed(vector: np.ndarray, known: Frequencies) -> Weighed:
    """Different shingles of a sorted vector, their weights, and the sum of these."""
    shingle, count = np.unique(vector, return_counts=True)
    weights = known.weights(shingle, count)
    return shingle, weights, float(weights.sum())


def similarity(a: Weighed, b: Weighed) -> float:
    """Weighted Jaccard similarity of two weighed vectors."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (x, of_x, sum_x), (y, of_y, sum_y) = a, b
    at = np.minimum(y.searchsorted(x), len(y) - 1) if len(y) else np.empty(0, np.int64)
    same = y[at] == x if len(y) else np.zeros(len(x), bool)
    shared = float(np.minimum(of_x[same], of_y[at[same]]).sum())
    whole = sum_x + sum_y - shared
    return shared / whole if whole else 0.0


def linked(a: tuple[Weighed, Weighed], b: tuple[Weighed, Weighed], threshold: float) -> bool:
    """Whether two texts (see :func:`opened_both`) are at least so similar by weights or by counts."""
    for x, y in zip(a, b, strict=True):
        if min(x[2], y[2]) >= threshold * max(x[2], y[2]) and similarity(x, y) >= threshold:  # what is shared is no more than the lesser sum
            return True
    return False


def weighted_jaccard(a: np.ndarray, b: np.ndarray, known: Frequencies) -> float:
    """Weighted Jaccard similarity of two sorted shingle vectors by TF-IDF or by counts, whichever is larger."""
    counts = [(x, n.astype(np.float64), float(n.sum())) for x, n in (np.unique(v, return_counts=True) for v in (a, b))]
    return max(similarity(weighed(a, known), weighed(b, known)), similarity(*counts))


def _signed(vectors: DataFrame, config: NearConfig) -> DataFrame:
    """rid, keys (a 64-bit hash for each band, those by counts last) and signature (32 bits of each sample)."""
    bands = config.bands + config.count_bands

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = worker_state("near dedup signatures", lambda: _draws(config.samples))
        for b in batches:
            k = 0
            while k < b.num_rows:
                texts, first, held = [], k, 0
                while k < b.num_rows and held < 1 << 19:
                    texts.append(opened_both(b["vector"][k].as_buffer()))
                    held += len(texts[-1][0][0]) * 4
                    k += 1
                sizes = np.array([len(w[0]) for w, _ in texts])
                shingle, begin, by_weight = np.concatenate([w[0] for w, _ in texts]), np.cumsum(sizes) - sizes, config.bands * config.band_samples
                found = [samples(shingle, np.concatenate([w[1] for w, _ in texts]), begin, draws[:by_weight]), count_samples(shingle, np.concatenate([n[1] for _, n in texts]), begin, draws[by_weight:])]
                found = np.concatenate(found, axis=1)
                key = np.zeros((len(texts), bands), dtype=np.uint64)
                for s in range(config.band_samples):
                    key = key * _U(_BASE) + found[:, s :: config.band_samples]
                key = _mix(key + np.arange(bands, dtype=np.uint64) * _U(_GOLD)).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), pa.array(key.ravel()))
                low = found.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([b["rid"].slice(first, k - first), keys, pa.array([x.tobytes() for x in low], pa.binary())], ["rid", "keys", "signature"])

    return vectors.mapInArrow(sign, "rid binary, keys array<long>, signature binary")


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs a-b whose weighted Jaccard similarity, by weights or by counts, is at least the threshold."""
    nodes = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    needed = durable(vectors.join(nodes, "rid"))
    rows = pairs.join(needed.select(F.col("rid").alias("a"), F.col("vector").alias("va")), "a").join(needed.select(F.col("rid").alias("b"), F.col("vector").alias("vb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b["va"], b["vb"]
            good = [linked(opened_both(left[k].as_buffer()), opened_both(right[k].as_buffer()), threshold) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return durable(rows.select("a", "b", "va", "vb").mapInArrow(verify, "a binary, b binary"))


def _apart(signed: DataFrame, bands: DataFrame, labels: DataFrame, vectors: DataFrame, config: NearConfig) -> DataFrame:
    """Links a-b between texts of a bucket with different labels, enough to connect all that are linked.

    The texts of a bucket that don't have its most frequent label are sent to blocks of all its texts; no text is
    sent to a block of a bucket whose texts all have one label. A pair is compared in the first band that it shares.
    """
    labelled = durable(bands.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid")))
    by_label = durable(labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")))
    buckets = by_label.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("size"), F.max(F.struct("n", "label"))["label"].alias("main")).filter("labels > 1").select("key", "size", "main")
    buckets = durable(buckets)
    total = buckets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    members = durable(look_up(labelled, buckets, "key", "size", total).filter("size IS NOT NULL"))
    nodes = members.select("rid").distinct()
    content = signed.select("rid", "signature").join(nodes, "rid").join(vectors, "rid")
    members = members.join(content, "rid").select("key", "band", "rid", "label", "signature", "vector", (F.col("label") != F.col("main")).alias("minor"), F.ceil(F.col("size") / config.block).cast("int").alias("blocks"))
    places = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)).cast("array<int>"))
    own = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    # Each text goes to its own block, and one that is apart to every block as well.
    targets = F.transform(places, lambda x: F.struct(x.alias("block"), F.lit(True).alias("sent")))
    targets = F.concat(F.array(F.struct(own.alias("block"), F.lit(False).alias("sent"))), F.when(F.col("minor"), targets).otherwise(F.filter(targets, lambda x: F.lit(False))))
    rows = members.withColumn("t", F.explode(targets)).select("key", "t.block", "t.sent", "band", "rid", "label", "signature", "vector")
    rows = rows.repartition(parts(signed.sparkSession), "key", "block").sortWithinPartitions("key", "block", "sent")
    most = 2048

    def compare(held: list[tuple], sent: list[tuple], band: int) -> Iterator[pa.RecordBatch]:
        rids, labels, marks, vectors = zip(*held, strict=True)
        table = np.frombuffer(b"".join(marks), dtype=np.uint32).reshape(len(held), -1, config.band_samples)
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        left, right = [], []
        ready: dict[int, tuple[Weighed, Weighed]] = {}

        def of(k: int) -> tuple[Weighed, Weighed]:
            if k not in ready:
                ready[k] = opened_both(vectors[k])
            return ready[k]

        for rid, label, mark, vector in sent:
            same = table == np.frombuffer(mark, dtype=np.uint32).reshape(-1, config.band_samples)
            agree = same.sum(axis=(1, 2))
            first = same.all(axis=2).argmax(axis=1) == band
            near = np.flatnonzero(first)
            if not len(near):
                continue
            mine = opened_both(vector)
            for k in near[np.argsort(-agree[near], kind="stable")].tolist():
                if find(label) != find(labels[k]) and linked(mine, of(k), config.threshold):
                    root[find(label)] = find(labels[k])
                    left.append(rid)
                    right.append(rids[k])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, sent, now = None, [], [], 0
        for b in batches:
            for key, block, is_sent, band, *row in zip(*(b[c].to_pylist() for c in ("key", "block", "sent", "band", "rid", "label", "signature", "vector")), strict=True):
                if (key, block) != at:
                    if held and sent:
                        yield from compare(held, sent, now)
                    at, held, sent, now = (key, block), [], [], band
                if is_sent and len(sent) >= most:
                    if held:
                        yield from compare(held, sent, now)
                    sent = []
                (sent if is_sent else held).append(tuple(row))
        if held and sent:
            yield from compare(held, sent, now)

    return durable(rows.mapInArrow(blocks, "a binary, b binary"))


def _weighed_texts(texts: DataFrame, config: NearConfig) -> DataFrame:
    """rid and vector of every different text with words, weighed by exact document frequencies."""
    spark = texts.sparkSession
    packs = durable(_packs(texts))
    sweep(spark)
    sizes = packs.select(F.explode("sizes").alias("n"))
    n, held = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # A shingle takes two bytes of text at least, about six in prose.
    found = durable(document_frequencies(packs, config, max(parts(spark), held // (4 * RANGE_SHINGLES))))
    sweep(spark)
    return weights_of(packs, found, n, config)


def _with_classes(docs: DataFrame, config: NearConfig) -> DataFrame:
    """doc_id, rid (MD5 of the text), class_id, class_size and keeper (the rid of the text that stays) of every row."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("rid", F.unhex(F.md5(F.col("text"))))
    vectors = durable(_weighed_texts(texts, config))
    sweep(spark)
    signed = durable(_signed(vectors, config))
    bands = signed.select("rid", F.posexplode("keys").alias("band", "key"))
    leaders = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("rid").alias("h"), "rid"))["rid"].alias("leader")).filter("n > 1")
    leaders = durable(leaders)
    total = leaders.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bands = durable(look_up(bands, leaders, "key", "n", total).filter("n IS NOT NULL"))
    led = bands.filter("rid <> leader").groupBy("rid", "leader").agg(F.count(F.lit(1)).alias("shared"))
    # A text is compared with the leader of most of its buckets.
    first = durable(led.groupBy("rid").agg(F.max(F.struct("shared", "leader"))["leader"].alias("leader")))
    links = _verified(first.select(F.col("rid").alias("a"), F.col("leader").alias("b")), vectors, config.threshold)
    # A leader comes before its texts in hash order, so these links have no cycle.
    labels = follow(links.select(F.col("a").alias("node"), F.col("b").alias("root"))).select(F.col("node").alias("rid"), F.col("root").alias("label"))
    more = _apart(signed, bands.select("key", "band", "rid"), labels, vectors, config)
    labels = components(links.unionByName(more)).select(F.col("node").alias("rid"), F.col("root").alias("label"))
    ids = texts.select("doc_id", "rid")
    per_text = ids.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    per_text = durable(per_text.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid")))
    per_class = per_text.groupBy("label").agg(F.sum("n").alias("class_size"), F.max(F.struct("top", "rid")).alias("keeper"), F.count(F.lit(1)).alias("texts"))
    per_class = per_class.select("label", "class_size", F.col("keeper.top").alias("class_id"), F.col("keeper.rid").alias("keeper"), "texts")
    classes = look_up(per_text.select("rid", "label", "n"), per_class, "label", "texts", per_text.count()).select("rid", "n", "class_id", "class_size", "keeper")
    classes = durable(classes)
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return look_up(ids, classes, "rid", "n", total).select("doc_id", "rid", "class_id", F.col("class_size").cast("long").alias("class_size"), "keeper")


def _kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("rid") == F.col("keeper"))


def near_groups(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """doc_id, class_id, class_size and kept of every row of ``docs``.

    A class holds the texts that links connect, with all their exact copies; its id is its largest doc_id, and one row
    with that id is kept. Texts without words, null among them, are in a class with their exact copies only. A class
    whose ids are all null has no id and keeps one text. Rows that repeat an id are members like others; where rows of one
    class have its id and different texts, one text is kept. An empty
    table gives an empty result; columns other than doc_id and text are not read.
    """
    return _with_classes(docs, config).select("doc_id", "class_id", "class_size", _kept().alias("kept"))


def drop_near_copies(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """One row of each class of :func:`near_groups`, with all columns."""
    kept = _with_classes(docs, config).filter(_kept()).select(row_key(F.col("doc_id"), F.hex("rid")).alias("key"))
    return rows_with_keys(docs, row_key(F.col("doc_id"), F.upper(F.md5(text_or_empty()))), kept)
