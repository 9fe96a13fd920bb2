"""SentencePiece encoding and decoding: the N best segmentations of a text over the lattice of a public model's pieces.

A segmentation's score is the sum of its pieces' scores. Pieces never reach across a space that follows another letter, nor a
line feed, so the lattice falls into chunks; a chunk falls into parts between letters that no piece joins, as those of a word and a
comma. Viterbi passes over all new parts of one length at once give each part's best segmentation and what the second best loses, a
chunk's are put together of its parts'. The n best segmentations of a text differ from its best in at most n - 1 chunks, those that lose
least; there forward Viterbi scores are the exact heuristic of a backward A-star search, which pops complete segmentations in
the order of their scores, and the chunks' losses are merged. A task keeps the chunks it has met. Pieces are looked up by 64-bit hashes.

A letter without a piece is written as the byte pieces of its UTF-8 form and costs what the worst piece costs and 10 more. The
text gets a space in front, spaces are the model's space mark, and nothing else is normalised; a literal space mark is written
in bytes, so that decoding returns every text as it was. This is the lattice's optimum by piece scores, not the library's merges.

Cases: a null or empty text is one space piece; the best segmentation is that of which, from the end, the shortest piece was
taken among equal scores, for the others the search's order decides: both depend on the chunk alone; long runs of one letter
cost time in proportion to their length; a text may have fewer than N segmentations; repeated rows are answered alike; an empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import caches, load, texts, tidy

#: Chunks and parts that a task keeps; beyond, the memory starts anew: results do not change. Parts of more than LONG letters
#: are searched one by one; a Viterbi pass takes parts of PASS letters together.
CACHE_CHUNKS, CACHE_SEARCHES, LONG, PASS = 500_000, 20_000, 48, 24_000
UNKNOWN_COST = 10.0
_ROLL, _BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(48)
_models: dict[str, "PieceModel"] = {}
_chunks = re.compile(r" +[^ \n]*|[^ \n]+|\n").findall
# a worker that waits for other tasks holds no chunks
caches.append(lambda: [(m.known.clear(), m.searched.clear()) for m in _models.values()])


def model(path: str) -> "PieceModel":
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.written: list[bytes] = []
        bytes_of: dict[int, int] = {}
        pieces: dict[str, tuple[float, int] | None] = {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_of[int(piece[3:5], 16)] = i
                self.written.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.written.append(b"")
            else:
                piece = piece.replace("▁", " ")
                self.written.append(piece.encode())
                pieces[piece] = (sp.get_score(i), i)
        self._setup(pieces, bytes_of)

    def _setup(self, pieces, bytes_of):
        self.bytes_of = bytes_of
        #: what is written, in one, and where each piece's part of it begins
        self.letters = np.frombuffer(b"".join(self.written), np.uint8)
        self.sizes = np.array([len(w) for w in self.written], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.worst = min((s for s, _ in pieces.values() if s > -1e8), default=0.0)
        self.entries: dict[str, tuple[float, int] | None] = {}
        for piece in pieces:
            for k in range(1, len(piece)):
                self.entries.setdefault(piece[:k], None)
        self.entries.update(pieces)
        self.longest = max(map(len, pieces))
        self.parts = _cutter(pieces)
        #: by length: hashes of the pieces in order, their ids and their scores; and whether a hash begins with some bits
        self.by_length = {}
        self.begin = np.zeros((self.longest + 1, 1 << 16), bool)
        for length in range(1, self.longest + 1):
            own = sorted((_rolled(p), i, s) for p, (s, i) in pieces.items() if len(p) == length) or [(0, 0, -np.inf)]
            keys, ids, scores = zip(*own, strict=True)
            if len(set(keys)) < len(keys):
                raise ValueError("pieces with equal hashes")
            self.by_length[length] = np.array(keys, np.uint64), np.array(ids, np.uint16), np.array(scores)
            self.begin[length, self.by_length[length][0] >> _BEGIN] = True
        self.known: dict[str, tuple[float, bytes, float]] = {}
        self.searched: dict[tuple[int, str], list] = {}

    @classmethod
    def of(cls, pieces: dict[str, float]) -> "PieceModel":
        """A model of given pieces and scores; bytes take the first 256 ids. For tests."""
        self = cls.__new__(cls)
        self.written = [bytes([b]) for b in range(256)] + [p.encode() for p in pieces]
        self._setup({p: (float(s), 256 + k) for k, (p, s) in enumerate(pieces.items())}, {b: b for b in range(256)})
        return self

    def nbest(self, chunk: str, n: int, first: tuple[float, tuple[int, ...]] | None = None) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the chunk's n best segmentations, the best first: the one told, or that of the forward pass, where among
        equal scores the shortest last piece wins, as in _viterbi(). Others of equal score are met in the order of the search."""
        size = len(chunk)
        forward = [-1e300] * (size + 1)
        forward[0] = 0.0
        arcs: list[list] = [[] for _ in range(size + 1)]
        came: list[tuple] = [()] * (size + 1)
        entries = self.entries
        missing = object()
        for i in range(size):
            here, single = forward[i], False
            for j in range(i + 1, size + 1):
                e = entries.get(chunk[i:j], missing)
                if e is missing:
                    break
                if e is not None:
                    single = single or j == i + 1
                    arc = (i, e[0], (e[1],))
                    arcs[j].append(arc)
                    if here + e[0] >= forward[j]:
                        forward[j], came[j] = here + e[0], arc
            if not single:
                cost = self.worst - UNKNOWN_COST
                arc = (i, cost, tuple(self.bytes_of[b] for b in chunk[i].encode("utf-8", "surrogatepass")))
                arcs[i + 1].append(arc)
                if here + cost >= forward[i + 1]:
                    forward[i + 1], came[i + 1] = here + cost, arc
        if first is None:
            best, at = [], size
            while at:
                best.append(came[at][2])
                at = came[at][0]
            first = (forward[size], tuple(x for ids in reversed(best) for x in ids))
        return [first, *self._search(size, arcs, forward, n, first)][:n] if n > 1 else [first]

    @staticmethod
    def _search(size: int, arcs, forward, n: int, first) -> list:
        """Backward A-star search for the n best ways, but for the first. Ways are taken up by their score, of equal ones that
        nearest to the start: ties are followed to their end, one at a time. No place is left more than n times, since what the
        n best ways have behind a place are its n best ends."""
        # scores that differ by rounding alone are equal
        out, heap, made = [], [(round(-forward[size], 6), size, 0, 0.0, None)], 0
        left = [0] * (size + 1)
        while heap and len(out) < n:
            _, at, _, after, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((after, tuple(ids)))
                continue
            left[at] += 1
            if left[at] > n:
                continue
            for i, cost, ids in arcs[at]:
                if left[i] < n:
                    made += 1
                    heapq.heappush(heap, (round(-(after + cost + forward[i]), 6), i, made, after + cost, (ids, path)))
        return sorted((way for way in out if way[1] != first[1]), key=lambda way: -way[0])

    def _learn(self, chunks: set[str]) -> None:
        """Finds (best score, its ids as bytes, what the second best segmentation loses) of chunks."""
        known = self.known
        cut = {c: p for c, p in zip(chunks, map(self.parts, chunks), strict=True) if len(p) > 1}
        by_size: dict[int, list[str]] = {}
        for c in chunks.difference(cut).union(*cut.values()).difference(known):
            by_size.setdefault(len(c), []).append(c)
        for size, same in by_size.items():
            step = max(1, PASS // size)
            for at in range(0, len(same), step):
                part = same[at : at + step]
                if size > LONG:
                    left = part
                else:
                    left = self._viterbi(part, size)
                for c in left:
                    best, *others = self.nbest(c, 2)
                    known[c] = best[0], np.array(best[1], "<u2").tobytes(), best[0] - others[0][0] if others else np.inf
        for c, parts in cut.items():
            scores, ids, losses = zip(*[known[p] for p in parts], strict=True)
            known[c] = sum(scores), b"".join(ids), min(losses)

    def _viterbi(self, chunks: list[str], size: int) -> list[str]:
        """Forward and backward Viterbi scores of chunks of one length, all at once. The second best segmentation has an arc
        that the best has not: its score is the best of those of the best ways through such arcs. Chunks with a letter
        that has no piece are returned. Arrays are by place, then by chunk."""
        m, longest = len(chunks), min(size, self.longest)
        letters = np.array(chunks, f"U{size}").view(np.uint32).reshape(-1, size).T.astype(np.uint64, order="C")
        cost, place = np.full((longest + 1, size, m), -np.inf), np.zeros((longest + 1, size, m), np.uint16)
        rolled = np.zeros((size + 1, m), np.uint64)
        for length in range(1, longest + 1):
            rolled = rolled[: size - length + 1] * _ROLL + letters[length - 1 :]
            keys, index, score = self.by_length[length]
            hashes = rolled.ravel()
            spots = np.flatnonzero(self.begin[length][hashes >> _BEGIN])
            hashes = hashes[spots]
            near = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[near] == hashes
            spots, near = spots[hit], near[hit]
            cost[length].reshape(-1)[spots], place[length].reshape(-1)[spots] = score[near], index[near]
        whole = np.isfinite(cost[1]).all(0)
        forward = np.full((size + 1, m), -np.inf)
        came = np.zeros((size + 1, m), np.uint8)
        forward[0] = 0.0
        for j in range(1, size + 1):
            for length in range(1, min(j, longest) + 1):
                way = forward[j - length] + cost[length, j - length]
                better = way > forward[j]
                np.copyto(forward[j], way, where=better)
                np.copyto(came[j], np.uint8(length), where=better)
        backward = np.full((size + 1, m), -np.inf)
        backward[size] = 0.0
        for i in range(size - 1, -1, -1):
            for length in range(1, min(size - i, longest) + 1):
                np.maximum(backward[i], cost[length, i] + backward[i + length], out=backward[i])
        for length in range(1, longest + 1):
            through = cost[length, : size - length + 1]
            through += forward[: size - length + 1]
            through += backward[length:]
        at, live = np.full(m, size), np.arange(m)
        taken, n_ids = np.zeros((m, size), np.uint16), np.zeros(m, np.int64)
        while len(live):
            step = np.maximum(came[at[live], live], 1)  # 0: of rows that are not whole
            at[live] -= step
            cost[step, at[live], live] = -np.inf
            n_ids[live] += 1
            taken[live, size - n_ids[live]] = place[step, at[live], live]
            live = live[at[live] > 0]
        second = cost.max((0, 1))
        best = forward[size]
        with np.errstate(invalid="ignore"):  # rows that are not whole
            loss = best - second
        known, raw, wide = self.known, taken.astype("<u2").tobytes(), 2 * size
        found = zip(chunks, best.tolist(), n_ids.tolist(), loss.tolist(), whole.tolist(), range(wide, wide * m + 1, wide), strict=True)
        for c, score, n, lost, fits, end in found:
            if fits:
                known[c] = score, raw[end - 2 * n : end], lost
        return [chunks[k] for k in np.flatnonzero(~whole).tolist()]

    def others(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """(loss, ids) of the n - 1 segmentations after the best one, by A-star search."""
        found = self.searched.get((n, chunk))
        if found is None:
            best, ids, _ = self.known[chunk]
            found = [(best - score, way) for score, way in self.nbest(chunk, n, (best, tuple(np.frombuffer(ids, "<u2").tolist())))[1:]]
            if len(self.searched) >= CACHE_SEARCHES:
                self.searched.clear()
            if len(chunk) <= LONG:
                self.searched[n, chunk] = found
        return found

    def encode(self, text: str, n: int):
        return next(self.encode_all([text], n))

    def encode_all(self, texts: list[str], n: int):
        """Of each text (ids of the best segmentation as two-byte numbers, [(score, swaps)] of the n best; a swap is (place in
        the best ids, how many of them go, ids that come), in order)."""
        for group in _portions(texts):
            chunks = [_chunks(" " + t) for t in group]
            missing = set(filterfalse(self.known.__contains__, chain.from_iterable(chunks)))
            if missing:
                if len(self.known) + len(missing) > CACHE_CHUNKS:
                    self.known.clear()
                    missing = set().union(*chunks)
                self._learn(missing)
            known = self.known
            for cs in chunks:
                scores, parts, losses = zip(*map(known.__getitem__, cs), strict=True)
                total = sum(scores)
                ways: list[tuple[float, tuple]] = [(0.0, ())]
                # of n segmentations at most n - 1 chunks differ from the best, those that lose least
                for k in _least(np.array(losses), n - 1).tolist() if n > 1 else ():
                    if np.isfinite(losses[k]):
                        more = [(loss + extra, (*swaps, (k, ids))) for loss, swaps in ways for extra, ids in self.others(cs[k], n)]
                        ways = sorted([*ways, *more], key=lambda w: w[0])[:n]
                out = []
                for loss, swaps in ways:
                    written = [(sum(map(len, parts[:k])) // 2, len(parts[k]) // 2, list(ids)) for k, ids in sorted(swaps)]
                    out.append((total - loss, written))
                yield b"".join(parts), out

    @staticmethod
    def swapped(ids: bytes, swaps) -> np.ndarray:
        """The ids of another segmentation, from the best one's."""
        best, parts, at = np.frombuffer(ids, "<u2"), [], 0
        for first, gone, come in swaps:
            parts += [best[at:first], np.array(come, "<u2")]
            at = first + gone
        return np.concatenate([*parts, best[at:]])

    def same_text(self, ids: bytes, swaps) -> bool:
        """Whether what comes is written as what goes is."""
        best, written = np.frombuffer(ids, "<u2"), self.written
        return all(b"".join(written[i] for i in best[first : first + gone].tolist()) == b"".join(written[i] for i in come) for first, gone, come in swaps)

    def decode(self, ids: bytes) -> str:
        best = np.frombuffer(ids, "<u2")
        sizes = self.sizes[best]
        ends = np.cumsum(sizes)
        # a piece's bytes are in a row
        return self.letters[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[best] - ends + sizes, sizes)].tobytes().decode("utf-8", "replace")[1:]


def _cutter(pieces):
    """What cuts a chunk into parts that no piece reaches across. Letters that stand beside one another in a piece are of one
    kind, so are those of a kind with either; a part is a run of one kind, with the spaces in front of it."""
    kind: dict[str, str] = {}

    def of(letter: str) -> str:
        while (up := kind.setdefault(letter, letter)) != letter:
            kind[letter] = kind[up]
            letter = up
        return letter

    for piece in pieces:
        for a, b in zip(piece, piece[1:], strict=False):
            if " " not in (a, b):
                kind[of(a)] = of(b)
    kinds: dict[str, str] = {}
    for letter in sorted(kind):
        kinds[of(letter)] = kinds.get(of(letter), "") + letter
    runs = [f"[{re.escape(letters)}]+" for letters in sorted(kinds.values(), key=len, reverse=True)]
    return re.compile(f" *(?:{'|'.join([*runs, '[^ ]'])})| +", re.DOTALL).findall


def _rolled(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_ROLL) + ord(c)) & 0xFFFFFFFFFFFFFFFF
    return h


def _portions(texts: list[str], letters: int = 2_000_000):
    """Texts in groups of about so many letters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= letters:
            yield group
            group, size = [], 0
    if group:
        yield group


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The places of the n least values, by value and place."""
    if n >= len(x):
        return np.argsort(x, kind="stable")
    edge = np.partition(x, n - 1)[n - 1]
    places = np.flatnonzero(x <= edge)
    return places[np.argsort(x[places], kind="stable")][:n]


def apply_swaps(ids: list[int], swaps) -> list[int]:
    """The ids of another segmentation, from the best one's."""
    out, at = [], 0
    for first, gone, come in swaps:
        out += ids[at:first] + list(come)
        at = first + gone
    return out + ids[at:]


def _checksum(ids: bytes | np.ndarray) -> int:
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


_SWAP = "array<struct<first: int, gone: int, come: array<int>>>"
_SWAP_TYPE = pa.list_(pa.list_(pa.struct([("first", pa.int32()), ("gone", pa.int32()), ("come", pa.list_(pa.int32()))])))
RESULT = f"doc_id long, n_pieces long, ids binary, scores array<double>, swaps array<{_SWAP}>"


def segment(docs: DataFrame, model_path: str, n: int = 3) -> DataFrame:
    """A row for each document: doc_id, n_pieces, ids (of the best segmentation, two bytes each), scores of the n best and the
    swaps that turn the best into each of them."""

    def run(batches):
        m = model(model_path)
        for batch in batches:
            ids, scores, swaps = [], [], []
            for best, ways in m.encode_all(batch.column("text").to_pylist(), n):
                ids.append(best)
                scores.append([s for s, _ in ways])
                swaps.append([[dict(zip(("first", "gone", "come"), x, strict=True)) for x in w] for _, w in ways])
            arrays = [batch.column("doc_id"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(scores, pa.list_(pa.float64())), pa.array(swaps, _SWAP_TYPE)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_pieces", "ids", "scores", "swaps"])

    return texts(docs).mapInArrow(tidy(run), RESULT)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows with decoded, the text of ids, in place of ids, and ids_crc32, the CRC-32 of the ids as little-endian 32-bit numbers."""

    def run(batches):
        m = model(model_path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            kept = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([m.decode(x) for x in ids], pa.string()), pa.array(map(_checksum, ids), pa.int64())], [*kept, "decoded", "ids_crc32"])

    kept = [f for f in encoded.schema.fields if f.name != "ids"]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "decoded string, ids_crc32 long"])
    return encoded.mapInArrow(tidy(run), schema)


ROUND_TRIP = "doc_id long, n_pieces long, scores array<double>, ids binary, ids_crc32 long, ways_crc32 array<long>, text_crc32 long, ways_decode boolean"


def round_trip(docs: DataFrame, model_path: str, n: int = 3) -> DataFrame:
    """segment() and decode() in one pass: doc_id, n_pieces, scores, ids and ids_crc32 of the best segmentation, ways_crc32 (that
    of each of the n best), text_crc32 of the text decoded from the best one's ids, and whether all ways decode to that text."""

    def run(batches):
        m = model(model_path)
        for batch in batches:
            rows = [[] for _ in range(7)]
            for best, ways in m.encode_all(batch.column("text").to_pylist(), n):
                own = [_checksum(m.swapped(best, swaps)) if swaps else _checksum(best) for _, swaps in ways]
                fits = all(m.same_text(best, swaps) for _, swaps in ways)
                text = m.decode(best).encode("utf-8", "surrogatepass")
                for column, value in zip(rows, (len(best) // 2, [s for s, _ in ways], best, _checksum(best), own, zlib.crc32(text), fits), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.list_(pa.float64()), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(rows, types, strict=True)]], [x.split()[0] for x in ROUND_TRIP.split(", ")])

    return texts(docs).mapInArrow(tidy(run), ROUND_TRIP)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_query(spark, sf_dir):
    """doc_id, n_pieces, score, score_2, score_3 (null: fewer segmentations), the CRC-32 of each one's ids, text_crc32 of the text
    decoded from the best one's, and ways_decode: whether the others decode to that text too."""
    out = round_trip(load(spark, sf_dir, "documents"), default_model())
    of = lambda c, name: [F.get(c, F.lit(k)).alias(f"{name}{'' if not k else f'_{k + 1}'}") for k in range(3)]
    return out.select("doc_id", "n_pieces", *of("scores", "score"), *of("ways_crc32", "ids_crc32"), "text_crc32", "ways_decode")
