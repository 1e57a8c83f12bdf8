"""SentencePiece encoding and decoding as a weighted finite-state transducer over the tropical semiring.

Three machines are compiled from a model: the normaliser (its character map as a trie, the handling of white space, a
dummy prefix and an escape for spaces), the pieces with a byte fallback for characters that no piece has, and an
acceptor of neighbouring pieces. They are composed with each text as far as the search for the shortest path goes: it
takes states by weight, and of equal weights the furthest first. In a merge model the
score of a piece is its merge priority and not a cost, so the sum of scores doesn't choose the segmentation; what a merge
model forbids is two neighbours that its merges would have joined or cut differently. The acceptor therefore gives
a pair of neighbours weight 0 if merging their joint text leaves exactly these two, else infinity. Each text has one
path of finite weight, which is the model's segmentation; a unigram model has no such acceptor, and its pieces' negated
scores are the weights.
"""

from __future__ import annotations

import heapq
import math
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .durable import ship, worker_state

SPACE = "▁"
#: Chunks whose ids a worker keeps before it drops those not used lately, the longest chunk kept, and neighbours kept.
CACHE_CHUNKS, CACHE_CHARS, CACHE_PAIRS = 300_000, 48, 500_000
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Normaliser:
    """The first machine: it rewrites the longest match of the character map at each place and copies what has none, then treats white space."""

    def __init__(self, spec) -> None:
        self.rules: dict = {}  # a trie: character to (rules that go on, replacement or None)
        for source, target in character_map(spec.precompiled_charsmap).items():
            node = self.rules
            for c in source[:-1]:
                node = node.setdefault(c, ({}, None))[0]
            node[source[-1]] = (node.get(source[-1], ({}, None))[0], target)
        self.first = re.compile(f"[{re.escape(''.join(self.rules))}]") if self.rules else None
        self.tidy, self.escape = spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.prefix = (SPACE if self.escape else " ") if spec.add_dummy_prefix else ""

    def _rewrite(self, text: str) -> str:
        out, at = [], 0
        while found := self.first.search(text, at):
            out.append(text[at : found.start()])
            at = found.start()
            node, end, best, target = self.rules, at, at + 1, text[at]
            while end < len(text) and (arc := node.get(text[end])):
                node, end = arc[0], end + 1
                if arc[1] is not None:
                    best, target = end, arc[1]
            out.append(target)
            at = best
        return "".join([*out, text[at:]])

    def __call__(self, text: str) -> str:
        if self.first:
            text = self._rewrite(text)
        if self.tidy:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return ""
        return self.prefix + (text.replace(" ", SPACE) if self.escape else text)


def character_map(blob: bytes) -> dict[str, str]:
    """The rewriting rules of a compiled character map: a double-array trie of UTF-8 strings, and their replacements one after another.

    A unit of the array has a label, an offset to its children and a mark whether a value hangs on it; all units of
    one depth are read at once.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
    texts = blob[4 + size :]
    offset = (units >> 10) << ((units & (1 << 9)) >> 6)
    labels = np.arange(1, 256)
    nodes, keys, out = np.array([offset[0]]), [b""], {}
    while len(nodes):
        at = nodes[:, None] ^ labels[None, :]
        inside = at < len(units)
        child = inside & ((units[np.where(inside, at, 0)] & 0x800000FF) == labels[None, :])
        row, column = np.nonzero(child)
        place = at[row, column]
        keys = [keys[r] + bytes([c]) for r, c in zip(row.tolist(), labels[column].tolist(), strict=True)]
        nodes = place ^ offset[place]
        for k in np.flatnonzero((units[place] >> 8) & 1).tolist():
            begin = int(units[nodes[k]] & 0x7FFFFFFF)
            out[keys[k].decode()] = texts[begin : texts.index(b"\0", begin)].decode()
    return out


class Transducer:
    """The machines of one model. ``encode`` composes them with a text and follows the shortest path."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normaliser, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type not in (UNIGRAM, MERGES) or not model.trainer_spec.byte_fallback:
            raise ValueError("only unigram and merge models with byte fallback are compiled")
        if kinds & {USER, UNUSED} or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with user-defined or unused pieces, or with spaces behind words, are not compiled")
        self.normalise = Normaliser(normaliser)
        self.merges = model.trainer_spec.model_type == MERGES
        self.prefix = self.normalise.prefix
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        self.longest = max(map(len, self.ids))
        self.chars = frozenset(c for p in self.ids for c in p)
        if self.merges and not all(c in self.ids for c in self.chars):
            raise ValueError("a merge model needs every character of its pieces as a piece")
        # No piece holds a space after another character, so paths part there; characters without a piece part them too.
        stop = "" if "\n" in self.chars else "\n"
        parts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+" + (f"|{stop}" if stop else "") if parts else r"(?s).+")
        # Nor does a piece hold one of these marks after a letter.
        after_letters = {y for p in self.ids for x, y in zip(p, p[1:], strict=False) if x.isalpha()}
        marks = re.escape("".join(sorted(set(string.punctuation) - after_letters)))
        self.marked = re.compile(rf"({SPACE}?[^\W\d_]+)([{marks}]+)" if marks else r"(?!)()()")
        self.out = [self._output(p) for p in model.pieces]
        self.fallback = 10 - min(self.scores.values())  # 10 more than the heaviest piece, as in the library
        self._arcs = frozenset(p for p in self.ids if not self.merges or self._merged(p) == [p])
        self._pairs: dict[tuple[str, str], bool] = {}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @staticmethod
    def _output(piece) -> bytes:
        if piece.type == BYTE:
            return bytes([int(piece.piece[3:5], 16)])
        if piece.type == CONTROL:
            return b""
        return " ⁇ ".encode() if piece.type == UNKNOWN else piece.piece.replace(SPACE, " ").encode()

    # The acceptor.

    def _merged(self, text: str) -> list[str]:
        """The merges of a short text, by definition: join the neighbours of the best score, leftmost first."""
        parts, get = list(text), self.scores.get
        scores = [get(a + b, -math.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > -math.inf:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], -math.inf)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], -math.inf)
        return parts

    def _neighbours(self, a: str, b: str) -> bool:
        if (known := self._pairs.get((a, b))) is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._merged(a + b) == [a, b]
        return known

    # Composition and shortest path.

    def shortest_path(self, text: str) -> list[str]:
        """The pieces on the path of least weight through the machines composed with a normalised text.

        Weights add along a path and the least of several counts. The search takes states by weight and composes the
        machines only where it goes. All finite weights of a merge model are 0, so its queue has one priority and is a
        stack; there the state is a place and the piece before it, else a place.
        """
        return self._merge_path(text) if self.merges else self._unigram_path(text)

    def _merge_path(self, text: str) -> list[str]:
        """The search with one priority: arcs of a state come longest first, and the stack holds the path to the state at hand.

        A position is reached by one path of finite weight at most, so one from which no arc leads on is never entered
        again, and the search is linear in the text.
        """
        arcs, chars, n = self._arcs, self.chars, len(text)
        out: list[str] = []
        dead: set[int] = set()
        at, size = 0, self.longest
        while at < n:
            before = out[-1] if out and out[-1] in arcs else None
            if text[at] not in chars:
                piece = text[at] if size and at + 1 not in dead else ""  # byte fallback, which no merge crosses
            else:
                piece = ""
                for end in range(min(n, at + size), at, -1):
                    found = text[at:end]
                    if found in arcs and end not in dead and (before is None or self._neighbours(before, found)):
                        piece = found
                        break
            if piece:
                out.append(piece)
                at += len(piece)
                size = self.longest
            elif out:
                dead.add(at)
                size = len(out[-1]) - 1
                at -= len(out.pop())
            else:
                raise ValueError(f"{text!r} has no path of finite weight")
        return out

    def _weighed_arcs(self, text: str, at: int) -> list[tuple[float, str]]:
        """The arcs that leave a place, by weight."""
        found = [(-self.scores[text[at:end]], text[at:end]) for end in range(at + 1, min(len(text), at + self.longest) + 1) if text[at:end] in self.ids]
        return sorted(found if text[at] in self.ids else [*found, (self.fallback, text[at])])

    def _unigram_path(self, text: str) -> list[str]:
        """The search by weight: a place's next arc waits in the queue, so that arcs are taken one at a time."""
        n = len(text)
        reached: dict[int, tuple[int, str] | None] = {0: None}
        waiting: list[tuple[float, int, int, str, float, Iterator[tuple[float, str]]]] = []
        at, weight = 0, 0.0
        while at < n:
            arcs = iter(self._weighed_arcs(text, at))
            first = next(arcs)
            heapq.heappush(waiting, (weight + first[0], -at - len(first[1]), at, first[1], weight, arcs))
            while True:
                total, end, source, piece, base, arcs = waiting[0]
                if following := next(arcs, None):
                    heapq.heapreplace(waiting, (base + following[0], -source - len(following[1]), source, following[1], base, arcs))
                else:
                    heapq.heappop(waiting)
                if -end not in reached:
                    break
            at, weight = -end, total
            reached[at] = (source, piece)
        out = []
        while step := reached[at]:
            at = step[0]
            out.append(step[1])
        return out[::-1]

    def path_ids(self, text: str) -> list[int]:
        """Ids of the shortest path through the machines composed with a normalised text."""
        out: list[int] = []
        for piece in self.shortest_path(text):
            found = self.ids.get(piece)
            if found is None:
                out += [self.bytes[x] for x in piece.encode("utf-8", "surrogatepass")]
            else:
                out.append(found)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; those of recent chunks are kept."""
        chunks = self.chunk.findall(self.normalise(text))
        ids = list(map(self._known.get, chunks))
        if None in ids:
            found: dict[str, bytes] = {}
            for k, x in enumerate(ids):
                if x is None:
                    c = chunks[k]
                    if c not in found:
                        found[c] = self._older.get(c) or self._parted(c, found)
                    ids[k] = found[c]
            if len(self._known) + len(found) > CACHE_CHUNKS:
                self._older, self._known = self._known, {}
            self._known.update((c, x) for c, x in found.items() if len(c) <= CACHE_CHARS)
        return b"".join(ids)

    def _parted(self, chunk: str, found: dict[str, bytes]) -> bytes:
        """Ids of a chunk; marks at its end are encoded apart from the letters before, which recur without them."""
        parts = m.groups() if (m := self.marked.fullmatch(chunk)) and m[1][-1].isalpha() else (chunk,)
        out = []
        for x in parts:
            ids = self._known.get(x) or self._older.get(x) or found.get(x) or np.asarray(self.path_ids(x), dtype="<u4").tobytes()
            out.append(ids)
            found[x] = ids
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: the machine read from its output to its input, without the dummy prefix."""
        out = b"".join(map(self.out.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        if self.prefix and out.startswith(b" "):
            out = out[1:]
        return out.decode("utf-8", "replace")


def transducer(path: str) -> Transducer:
    return worker_state(f"transducer of {path}", lambda: Transducer(path))


def sentencepiece_table(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32, decoded_crc32, round_trip, and ids if ``with_ids``, of every document.

    Whole texts are encoded and their ids decoded again. n_byte_tokens counts the ids of the byte fallback, ids_crc32 is
    the checksum of the ids as little-endian unsigned 32-bit integers, decoded_crc32 that of the decoded text in
    UTF-8, and round_trip tells whether the decoded text is the text. Null and empty texts have no ids and a round trip.
    Each row is encoded by itself, so rows that repeat give equal rows; an empty table gives an empty result; columns
    other than doc_id and text are not read. The path grows with the text's length only, so very long texts need
    memory in proportion to their length.
    """
    path = path or model_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        is_byte = np.zeros(len(t.pieces), dtype=bool)
        is_byte[list(t.bytes.values())] = True
        for b in batches:
            rows = []
            for x in b["text"]:
                text = x.as_py() or ""
                ids = t.encode(text)
                back = t.decode(ids)
                rows.append((len(ids) // 4, int(is_byte[np.frombuffer(ids, dtype="<u4")].sum()), zlib.crc32(ids), zlib.crc32(back.encode()), back == text, ids if with_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *made], ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_crc32", "round_trip", "ids"])

    ship(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean, ids binary"
    out = docs.select("doc_id", "text").mapInArrow(encode, schema)
    return out if with_ids else out.drop("ids")
