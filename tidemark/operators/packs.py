"""Postings in packs: a row for each word of many documents, made inside tasks, so that no word of a text is shuffled.

A pack has a number of its own. Fields, lengths and positions of a row travel as bytes of numbers of variable length, which
Spark moves without looking into them; the documents of a pack are one more row, in the bucket :data:`DOCUMENTS`.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Words, or postings, of a pack: what a Python worker holds at once.
PACK = 1_000_000
#: Bytes of a batch to a Python worker, where the session names no limit.
BATCH = 16 << 20
#: Columns of a posting, each an array in a pack.
ARRAYS = ("ids", "fields", "dls", "positions")
#: The bucket that the rows of documents come in.
DOCUMENTS = -1


def kinds(id_type: str) -> str:
    """Columns of packs in Spark."""
    return f"pack bigint, bucket int, term string, ids array<{id_type}>, coded binary"


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as bytes of seven bits each, lowest first, all but a number's last with the high bit; and where each begins, and the end."""
    size, more = np.ones(len(values), dtype=np.int64), np.flatnonzero(values > 127)
    over = values[more] >> 7
    while len(more):
        size[more] += 1
        more, over = more[over > 127], over[over > 127] >> 7
    begins = np.append(0, np.cumsum(size))
    out = np.empty(begins[-1], dtype=np.uint8)
    out[begins[:-1]] = values & 127
    more = np.flatnonzero(size > 1)
    left, at, size = values[more] >> 7, begins[more], size[more]
    while len(left):
        out[at] |= 128
        at = at + 1
        out[at] = left & 127
        some = size > 2
        left, at, size = left[some] >> 7, at[some], size[some] - 1
    return out, begins


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of :func:`_varints`, and where each begins."""
    ends = np.flatnonzero(data < 128)
    begins = np.append(0, ends[:-1] + 1) if len(ends) else ends
    values = (data[begins] & 127).astype(np.int64)
    some, k = np.flatnonzero(ends > begins), 1
    while len(some):
        values[some] |= (data[begins[some] + k] & 127).astype(np.int64) << (7 * k)
        k += 1
        some = some[ends[some] >= begins[some] + k]
    return values, begins


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes, cut at ``ends`` (the first one is 0)."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _bytes(coded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each row begins, and the end."""
    ends = np.frombuffer(coded.buffers()[1], dtype=np.int32)[coded.offset : coded.offset + len(coded) + 1]
    held = coded.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[ends[0] : ends[-1]] if held is not None else np.empty(0, dtype=np.uint8)
    return data, (ends - ends[0]).astype(np.int64)


def _places(n: np.ndarray, tf: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the fields of each posting and each position stand among numbers: a row of n postings has n fields, n lengths, n frequencies and then all positions."""
    first, count = np.cumsum(n) - n, np.append(0, np.cumsum(tf))
    head = np.repeat(begin - first, n) + np.arange(n.sum())
    base = np.repeat(begin + 3 * n - count[first], n) + count[:-1]
    return head, np.repeat(base - count[:-1], tf) + np.arange(count[-1])


def _coded(pack: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """A pack as it travels, with its number."""
    ids, positions = pack.column(2), pack.column(5).flatten()
    n = np.asarray(pc.list_value_length(ids), dtype=np.int64)
    tf = np.asarray(pc.list_value_length(positions), dtype=np.int64)
    at = np.asarray(positions.flatten(), dtype=np.int64)
    count = np.append(0, np.cumsum(tf))
    many = np.append(0, np.cumsum(3 * n + np.diff(count[np.append(0, np.cumsum(n))])))  # numbers of rows
    head, place = _places(n, tf, many[:-1])
    gaps = np.diff(at, prepend=0)
    gaps[count[:-1]] = at[count[:-1]]
    values, wide = np.empty(many[-1], dtype=np.int64), np.repeat(n, n)
    values[head], values[head + wide], values[head + 2 * wide], values[place] = pack.column(3).flatten(), pack.column(4).flatten(), tf, gaps
    data, begins = _varints(values)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number, dtype=np.int64)), pack.column(0), pack.column(1), ids, _binary(data, begins[many])], names=["pack", "bucket", "term", "ids", "coded"])


def _plain(bucket: pa.Array, term: pa.Array, ids: pa.Array, coded: pa.Array) -> pa.RecordBatch:
    """The pack (bucket, term, ids, fields, dls, positions) that :func:`_coded` was made of."""
    n = np.asarray(pc.list_value_length(ids), dtype=np.int64)
    data, rows = _bytes(coded)
    values, begins = _numbers(data)
    begin, wide, first = np.append(0, np.cumsum(data < 128))[rows[:-1]], np.repeat(n, n), np.append(0, np.cumsum(n))
    tf = values[np.repeat(begin - first[:-1], n) + np.arange(n.sum()) + 2 * wide]
    head, place = _places(n, tf, begin)
    count = np.append(0, np.cumsum(tf))
    upto = np.append(0, np.cumsum(values[place]))
    at = upto[1:] - np.repeat(upto[count[:-1]], tf)
    columns = [ids.flatten(), pa.array(values[head], pa.int32()), pa.array(values[head + wide], pa.int64()), _lists(count, pa.array(at, pa.int32()))]
    return _packed(bucket, term, first[:-1], columns)


def _left(pack: pa.RecordBatch, gone: pa.Array) -> pa.RecordBatch:
    """A pack as it travels without the postings of some documents, and without words that are left with none.

    A posting's numbers don't depend on those of others, so the bytes of the rest stay as they are and only frequencies are read.
    """
    ids, (data, rows) = pack.column(3), _bytes(pack.column(4))
    n, held = np.asarray(pc.list_value_length(ids), dtype=np.int64), ids.flatten()
    kept = ~np.asarray(pc.is_in(held, value_set=gone.cast(held.type)))
    if kept.all():
        return pack
    last = data < 128
    ends = np.flatnonzero(last)
    begins = np.append(0, ends + 1)
    begin, first = np.append(0, np.cumsum(last))[rows[:-1]], np.append(0, np.cumsum(n))
    head, wide = np.repeat(begin - first[:-1], n) + np.arange(first[-1]), np.repeat(n, n)
    which = head + 2 * wide
    tf, some, k = (data[begins[which]] & 127).astype(np.int64), np.flatnonzero(begins[which] < ends[which]), 1
    while len(some):
        at = begins[which[some]] + k
        tf[some] |= (data[at] & 127).astype(np.int64) << (7 * k)
        some, k = some[at < ends[which[some]]], k + 1
    numbers = np.ones(len(ends), dtype=bool)
    numbers[head], numbers[head + wide], numbers[which] = kept, kept, kept
    positions = np.ones(len(ends), dtype=bool)
    positions[head] = positions[head + wide] = positions[which] = False
    numbers[positions] = np.repeat(kept, tf)
    stays = np.repeat(numbers, np.diff(begins))
    many = np.add.reduceat(kept, first[:-1], dtype=np.int64)
    full = np.flatnonzero(many)
    coded = _binary(data[stays], np.append(0, np.append(0, np.cumsum(stays))[rows[1:]][full]))
    at = pa.array(full)
    left = _lists(np.append(0, np.cumsum(many[full])), held.filter(pa.array(kept)))
    return pa.RecordBatch.from_arrays([*(pack.column(c).take(at) for c in range(3)), left, coded], names=pack.schema.names)


def _without(pack: pa.RecordBatch, gone: pa.Array) -> pa.RecordBatch:
    """:func:`_left` of a plain pack."""
    left = _left(_coded(pack, 0), gone)
    return _plain(*left.columns[1:]) if len(left) else pack.slice(0, 0)


def _documents(rows: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """One row of the documents of a pack, whose numbers are the words of each field and 1, or 0 where a field is null."""
    sizes = [np.asarray(pc.fill_null(pc.add(pc.list_value_length(rows.column(k)), 1), 0), dtype=np.int64) for k in range(1, rows.num_columns)]
    data, _ = _varints(np.stack(sizes, axis=1).ravel())
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([DOCUMENTS], pa.int32()), pa.array([None], pa.string()), _lists(np.array([0, len(rows)]), rows.column(0)), pa.array([data.tobytes()], pa.binary())], names=["pack", "bucket", "term", "ids", "coded"])


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _packed(bucket: pa.Array, term: pa.Array, first: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch:
    """Postings in order of their words, of which a new one begins at each place in ``first``."""
    ends = np.append(first, len(columns[0]))
    return pa.RecordBatch.from_arrays([bucket, term, *(_lists(ends, c) for c in columns)], names=["bucket", "term", *ARRAYS])


def _order(keys: np.ndarray) -> np.ndarray:
    """Places of keys (32 bits, none negative) in order, equal ones as they came; by 16 bits at a time, which are sorted without comparisons."""
    low = np.argsort(keys.astype(np.uint16), kind="stable")
    high = (keys[low] >> 16).astype(np.uint16)
    return low[np.argsort(high, kind="stable")] if high.any() else low


def _words(texts: pa.Array) -> pa.ListArray:
    """The words of texts that have spaces between them (:func:`~tidemark.functions.text.spaced_words`), found in the bytes of all."""
    data, ends = _bytes(texts)
    inside = data != 32
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    some = ends[:-1][ends[:-1] < len(data)]
    begin[some] = inside[some]  # a text begins a word, whatever the one before ends with
    letters = data[inside]
    offsets = np.append(np.flatnonzero(begin[inside]), len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(letters))
    upto = pa.array(np.searchsorted(np.flatnonzero(begin), ends), pa.int32())
    return pa.ListArray.from_arrays(upto, words, mask=texts.is_null() if texts.null_count else None)


def _of_words(rows: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """The pack of documents (id, and an array of words for each field)."""
    n, flat, doc, field, at, sizes = len(rows), [], [], [], [], []
    for k in range(1, rows.num_columns):
        w = rows.column(k)
        size = np.asarray(pc.fill_null(pc.list_value_length(w), 0), dtype=np.int32)
        flat.append(pc.list_flatten(w).cast(pa.string()))
        doc.append(np.repeat(np.arange(n, dtype=np.int32), size))
        field.append(np.full(size.sum(), k - 1, dtype=np.int32))
        at.append(np.arange(size.sum(), dtype=np.int32) - np.repeat(np.cumsum(size, dtype=np.int32) - size, size))
        sizes.append(size)
    words = (flat[0] if len(flat) == 1 else pa.concat_arrays(flat)).dictionary_encode()
    terms, codes = words.dictionary, np.asarray(words.indices)
    of = (np.fromiter(map(zlib.crc32, terms.cast(pa.binary()).to_numpy(zero_copy_only=False)), dtype=np.int64, count=len(terms)) % buckets).astype(np.int32)
    sort = np.asarray(pc.sort_indices(terms)).astype(np.int64)
    sort = sort[_order(of[sort])]
    place = np.empty(len(sort), dtype=np.int32)
    place[sort] = np.arange(len(sort), dtype=np.int32)
    key = place[codes]
    order = _order(key)  # inside a word by field, document and position, as they came
    key, doc, field, at = (x[order] for x in (key, *map(np.concatenate, (doc, field, at))))
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (field[1:] != field[:-1])
    first = np.flatnonzero(new)
    key, doc, field = key[first], doc[first], field[first]
    dl = np.stack(sizes)[field, doc]
    columns = [rows.column(0).take(pa.array(doc)), pa.array(field, pa.int32()), pa.array(dl, pa.int64()), _lists(np.append(first, len(at)), pa.array(at, pa.int32()))]
    return _packed(pa.array(of[sort]), terms.take(pa.array(sort)), np.flatnonzero(np.append(True, key[1:] != key[:-1])), columns)


def _of_postings(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The pack of single postings (bucket, term, id, field, dl, positions)."""
    rows = rows.take(pc.sort_indices(pa.table(rows.columns[:2], names=["b", "t"]), [("b", "ascending"), ("t", "ascending")]))
    code = np.asarray(rows.column(1).dictionary_encode().indices)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    at = pa.array(first)
    return _packed(rows.column(0).take(at), rows.column(1).take(at), first, [rows.column(k) for k in range(2, 6)])


def _pieces(batches: Iterator[pa.RecordBatch], words: bool) -> Iterator[pa.RecordBatch]:
    """The rows again, in pieces of about :data:`PACK` words or postings, but whole rows; a row without words counts as one."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        size = np.ones(len(b), dtype=np.int64)
        if words:
            size = np.maximum(sum(np.asarray(pc.fill_null(pc.list_value_length(b.column(k)), 0), dtype=np.int64) for k in range(1, b.num_columns)), 1)
        ends, start = np.cumsum(size), 0
        while start < len(b):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + PACK - n, side="right")))
            held.append(b.slice(start, stop - start))
            n += int(ends[stop - 1] - before)
            start = stop
            if start < len(b) or n >= PACK:
                yield from _whole(held)
                held, n = [], 0
    if held:
        yield from _whole(held)


def _whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _begin(rows: DataFrame) -> None:
    spark = rows.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def of_words(rows: DataFrame, buckets: int) -> DataFrame:
    """Packs (see :func:`kinds`) of rows of an id and, for each field, the words of a text with spaces between them; and their documents."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = (pa.RecordBatch.from_arrays([b.column(0), *map(_words, b.columns[1:])], names=b.schema.names) for b in batches if len(b))
        for piece in _pieces(split, True):
            number = uuid.uuid4().int >> 65
            yield _documents(piece, number)
            if any(pc.any(pc.greater(pc.list_value_length(piece.column(k)), 0)).as_py() for k in range(1, piece.num_columns)):
                yield _coded(_of_words(piece, buckets), number)

    _begin(rows)
    return rows.mapInArrow(pack, kinds(rows.dtypes[0][1]))


def documents(packs: DataFrame, id_col: str, fields: int) -> DataFrame:
    """id, pack, and the words of each field (w0, w1, ...; null where it is null) of each document, from rows of documents."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            n = np.asarray(pc.list_value_length(b.column(1)), dtype=np.int64)
            values = _numbers(_bytes(b.column(2))[0])[0].reshape(-1, fields)
            sizes = [pa.array(values[:, k] - 1, pa.int64(), mask=values[:, k] == 0) for k in range(fields)]
            yield pa.RecordBatch.from_arrays([b.column(1).flatten(), b.column(0).take(pa.array(np.repeat(np.arange(len(b)), n))), *sizes], names=names)

    _begin(packs)
    names = [id_col, "pack", *(f"w{k}" for k in range(fields))]
    kind = dict(packs.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    return packs.select("pack", "ids", "coded").mapInArrow(unpack, f"{id_col} {kind}, pack bigint, {', '.join(f'w{k} bigint' for k in range(fields))}")


def postings(packs: DataFrame, id_col: str, *more: str) -> DataFrame:
    """A row for each posting: ``more``, bucket, term, id, field, dl and positions."""
    names = [*more, "bucket", "term", id_col, "field", "dl", "positions"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                plain = _plain(*b.columns[len(more) :])
                of = pa.array(np.repeat(np.arange(len(b)), np.asarray(pc.list_value_length(plain.column(2)), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(of) for k in range(len(more) + 2)), *(plain.column(k).flatten() for k in range(2, 6))], names=names)

    _begin(packs)
    types = dict(packs.dtypes)
    kind = types["ids"].removeprefix("array<").removesuffix(">")
    made = {c: types[c] for c in (*more, "bucket", "term")} | {id_col: kind, "field": "int", "dl": "bigint", "positions": "array<int>"}
    return packs.select(*more, "bucket", "term", "ids", "coded").mapInArrow(unpack, ", ".join(f"{c} {t}" for c, t in made.items()))


def without(packs: DataFrame, dead: DataFrame, id_col: str) -> DataFrame:
    """Packs without the postings of dead documents (id and pack). Packs meet their dead whole and in bytes, so no posting travels alone."""
    id_type = dict(dead.dtypes)[id_col]

    def keep(pack: pa.Table, gone: pa.Table) -> pa.Table:
        one = pack.combine_chunks()
        if len(gone) == 0 or len(one) == 0:
            return one
        left = _left(one.to_batches()[0], gone.combine_chunks().column(1).combine_chunks())
        return pa.Table.from_batches([left]) if len(left) else one.slice(0, 0)

    _begin(packs)
    held = packs.select("pack", "bucket", "term", "ids", "coded").groupBy("pack")
    return held.cogroup(dead.select("pack", id_col).groupBy("pack")).applyInArrow(keep, kinds(id_type))
