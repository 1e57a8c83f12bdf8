"""Packing: tokenise documents, cut them into pieces and pack the pieces by their length histogram."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable, ship, text_or_empty, worker_state

#: Words whose ids a worker keeps before it drops those not used lately, and the longest word that it keeps.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Control characters that ``str.split`` takes as white space and the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Outside these, lower-casing a text first might differ from what the tokenizer does character by character.
_BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")

#: Letters and then ASCII marks, which nothing composes with; an apostrophe may begin a suffix that is a token.
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts word by word; no token of this vocabulary spans white space, so words can be encoded apart.

    ``encode`` gives the ids as little-endian unsigned 32-bit integers. The vocabulary is of lower case, so Latin texts
    are lower-cased first, and marks after letters are tokens of their own; both make words recur. Ids of recent words
    are kept, up to a fixed number.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that end a word
        self._ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _fresh(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh_words(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space. Those of letters only are encoded in one call and parted after the tokens that end a word."""
        letters = [w for w in words if w.isalpha()]
        ids = np.asarray(self._tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self._ends[ids]) + 1) * 4
        if len(ends) != len(letters):  # a letter that becomes several characters may part a word
            return self._fresh(words)
        raw, at = ids.tobytes(), 0
        found = {}
        for w, end in zip(letters, ends.tolist(), strict=True):
            found[w] = raw[at:end]
            at = end
        rest = [w for w in words if w not in found]
        return [*map((found | dict(zip(rest, self._fresh(rest), strict=True))).__getitem__, words)]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that aren't kept."""
        older, known = self._older, self._known
        found = {w: older[w] for w in words if w in older}
        split = {w: m.groups() for w in words if w not in found and (m := _MARKED.fullmatch(w)) and m[1].isalpha() and m[1].lower().isalpha()}
        plain = words.difference(found, split)
        plain.update(x for pair in split.values() for x in pair if x not in known and x not in older)
        plain = list(plain)
        fresh = dict(zip(plain, self._fresh_words(plain), strict=True))
        found |= fresh
        for w, pair in split.items():
            found[w] = b"".join([fresh[x] if x in fresh else known[x] if x in known else older[x] for x in pair])
        return found

    def encode(self, text: str) -> bytes:
        if _NOT_SPACE.search(text):
            return self._fresh([text])[0]
        if not _BEYOND_LATIN.search(text):
            text = text.lower()
        words = text.split()
        ids = list(map(self._known.get, words))
        if None in ids:
            places = [k for k, x in enumerate(ids) if x is None]
            found = self._learn({words[k] for k in places})
            for k in places:
                ids[k] = found[words[k]]
            if len(self._known) + len(found) > CACHE_WORDS:
                self._older, self._known = self._known, {}
            self._known.update(found if max(map(len, found)) <= CACHE_CHARS else {w: x for w, x in found.items() if len(w) <= CACHE_CHARS})
        return b"".join(ids)


def encoder(path: str) -> WordEncoder:
    return worker_state(f"words of {path}", lambda: WordEncoder(path))


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns as (count, lengths): lengths are placed longest first, each into the emptiest open packs.

    Where no open pack has room, new packs take as many pieces of the length as fit, so equal pieces share packs.
    Only pattern counts are kept, so the work depends on the number of lengths and not on the number of pieces.
    """
    if any(not 0 < length <= size for length in histogram):
        raise ValueError(f"lengths must lie in 1..{size}")
    open_packs: dict[int, list[list]] = defaultdict(list)  # room -> [count, pattern]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in open_packs.items() if packs), default=0)
            if room < length:
                each = min(size // length, left)
                open_packs[size - each * length].append([left // each, (length,) * each])
                left %= each
                continue
            count, pattern = open_packs[room].pop()
            taken = min(count, left)
            if taken < count:
                open_packs[room].append([count - taken, pattern])
            open_packs[room - length].append([taken, (*pattern, length)])
            left -= taken
    return [(count, pattern) for _, packs in sorted(open_packs.items()) for count, pattern in packs]


def tokenised_pieces(docs: DataFrame, path: str, size: int, end_id: int = 1) -> DataFrame:
    """A row for each piece of at most ``size`` ids: where it lies, its checksum, and its place among pieces of its length in the partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, end = TaskContext.get().partitionId(), Counter(), np.asarray([end_id], dtype="<u4").tobytes()
        words = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for k, text in enumerate(b["text"]):
                ids = words.encode(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    rows.append((k, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), total, seen[length]))
                    seen[length] += 1
            if rows:
                owner, *cols = zip(*rows, strict=True)
                ids = b["doc_id"].take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols), pa.array([part] * len(rows), pa.int64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "part"])

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, nth long, part long")


def pack(docs: DataFrame, path: str | None = None, size: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of every document.

    A document is its ids and then id 1, so null and empty texts have one id; it is cut after every ``size`` ids.
    Pieces of a length are ranked without a sort: each partition counts its own and adds the pieces of the
    partitions before it. Patterns are joined back by that rank: a pattern with count c at a slot takes c
    consecutive ranks of the slot's length. Rows that repeat a doc_id, and null ids, are packed like others; an
    empty table gives an empty result; columns other than doc_id and text are not read.

    Only the histogram (at most ``size`` rows) reaches the driver, and the patterns' slots, whose number depends on
    ``size`` alone, are broadcast.
    """
    spark = docs.sparkSession
    pieces = durable(tokenised_pieces(docs, path or vocabulary_path(), size))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("__n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    slots, taken, sequence = [], Counter(), 0
    for count, pattern in shortest_pack_first(histogram, size):
        offset = 0
        for length in pattern:
            slots.append((length, taken[length], taken[length] + count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    slots.sort()
    lengths, firsts, lasts, sequences, offsets = (np.array(c, dtype=np.int64) for c in (zip(*slots, strict=True) if slots else [[]] * 5))
    shared = spark.sparkContext.broadcast((lengths, firsts, sequences, offsets))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "part", before.alias("__before"))
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("__before") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, sequences, offsets = shared.value
        edges = np.searchsorted(lengths, np.arange(size + 2))
        wide = np.int64(1) << 50
        keys = lengths * wide + firsts
        for b in batches:
            length, rank = (np.asarray(b[c]) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            assert (at >= edges[length]).all()
            made = [pa.array(sequences[at] + rank - firsts[at]), pa.array(offsets[at])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *made], [*names, "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
