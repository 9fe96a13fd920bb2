"""Benchmark decontamination: texts as templates of typed placeholders, windows joined by hash, slots checked for consistency.

A token is a white-space separated word without punctuation at its ends. Numbers, quantities (a number with a unit attached),
units after a number and capitalised words become placeholders, whatever stands around them; other words are lower-cased. A
window of WINDOW tokens (a shorter item: all its tokens) of which enough are literal is joined by its hash, and so is every
window of plain case-folded words. Where a window of the text meets one of an item, the two are laid upon each other: tokens fit
if their templates or their plain words are equal, so a run goes on over numbers and names alone and through other case. A run
counts while its slots are consistent: equal values of the item stand for equal values of the text and different ones for
different ones; every longest consistent run is found, wherever a conflict lies. A text is contaminated by an item with a run of
RUN tokens, or of the whole item where that is shorter. Re-parameterised questions are found that way, since their templates
are equal, and copies that differ in case. Of an item of under RUN tokens a run that needs plain words counts if it is in one case
throughout (capitals, lower case or titled) or in the item's own: few words of which one differs in case are no copy. An item of
under LEAST tokens is met by a text that is that item and nothing else, in any case: so few words stand in any text by chance.

The benchmark is the query set: it goes through the texts in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES of text, each
broadcast, so the texts are never shuffled.

Cases: a null or empty text is clean; a null or empty item matches nothing; repeated rows are judged alike; without a benchmark
all is clean; columns other than doc_id and text, item_id and text are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import caches, load, mix64, text_key, texts, tidy

WINDOW, RUN, LEAST, LITERAL = 10, 13, 6, 0.6
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 64 << 20

#: Unit words, after a number.
UNITS = frozenset("mm cm m km inch inches foot feet ft yard yards mile miles g kg mg lb lbs pound pounds ounce ounces ton tons second seconds s ms minute minutes min hour hours h day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent l ml litre litres liter liters gallon gallons degree degrees mph kmh hz khz mhz ghz kb mb gb tb watt watts volt volts".split())
_number = re.compile(r"[+-]?[$€£]?\d[\d.,]*%?").fullmatch
_quantity = re.compile(r"[+-]?\d[\d.,]*([A-Za-z]+)").fullmatch
_edges = "!\"'()*+,./:;<=>?@[\\]^_`{|}~#&-«»„“”‘’…¡¿"
_kinds = mix64(np.array([11, 22, 33, 44], np.uint64))
NUMBER, QUANTITY, NAME, UNIT = (int(x) for x in _kinds)
#: Words whose codes a task keeps from one text to the next.
CACHE_WORDS = 400_000


def _literal(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


#: Kinds of tokens: literal, literal that is a unit after a number, placeholders.
LITERAL_WORD, UNIT_WORD, NUMBER_SLOT, OTHER_SLOT = range(4)


def code(word: str) -> tuple[int, int, int]:
    """A token's code in the template, its kind, and its code as a plain case-folded word."""
    bare = word.strip(_edges) or word
    folded = bare.casefold()
    plain = _literal(folded)
    if _number(bare):
        return NUMBER, NUMBER_SLOT, plain
    m = _quantity(bare)
    if m and m[1].lower() in UNITS:
        return QUANTITY, OTHER_SLOT, plain
    if bare[0].isupper() and (len(bare) == 1 or bare[1:].islower()) and bare.isalpha():
        return NAME, OTHER_SLOT, plain
    low = bare.lower()
    return plain if low == folded else _literal(low), UNIT_WORD if low in UNITS else LITERAL_WORD, plain


class _Known(dict):
    """Words by their place in arrays of what code() says of them."""

    def __init__(self):
        self.clear()

    def clear(self):
        super().clear()
        self.codes, self.kinds, self.plain = np.zeros(1024, np.uint64), np.zeros(1024, np.int8), np.zeros(1024, np.uint64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == len(self.codes):
            self.codes, self.kinds, self.plain = (np.concatenate([x, np.zeros_like(x)]) for x in (self.codes, self.kinds, self.plain))
        self.codes[at], self.kinds[at], self.plain[at] = code(word)
        return at


_codes = _Known()
caches.append(_codes.clear)


class Template:
    def __init__(self, text: str):
        if len(_codes) >= CACHE_WORDS:
            _codes.clear()
        self.words = text.split()
        places = np.fromiter(map(_codes.__getitem__, self.words), np.int64, len(self.words))
        self.codes, self.plain, kinds = _codes.codes[places], _codes.plain[places], _codes.kinds[places]
        self.slots = kinds >= NUMBER_SLOT
        units = np.flatnonzero((kinds[1:] == UNIT_WORD) & (kinds[:-1] == NUMBER_SLOT)) + 1
        self.codes[units] = UNIT
        self.slots[units] = True

    def bare(self, i: int) -> str:
        return self.words[i].strip(_edges) or self.words[i]

    def value(self, i: int) -> str:
        return self.bare(i).lower()

    def one_case(self, first: int, n: int) -> bool:
        words = [self.bare(i) for i in range(first, first + n)]
        return any(all(w == f(w) for w in words) for f in (str.upper, str.lower, str.capitalize))


def windows(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of n tokens."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[k : k + count]
    return mix64(out)


class Items:
    """A block of the benchmark by the windows of its templates and of its plain words, short items by all their plain words."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.templates: dict[int, Template] = {}
        self.short: dict[bytes, list[int]] = {}
        forms: dict[int, dict[int, list[tuple[int, int]]]] = {}
        plain: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, (item, text) in enumerate(rows):
            t = Template(text or "")
            if len(t.codes) < LEAST:
                if len(t.codes):
                    self.short.setdefault(t.plain.tobytes(), []).append(item)
                continue
            self.templates[k] = t
            n = min(WINDOW, len(t.codes))
            literal = np.cumsum(np.concatenate([[0], ~t.slots]))
            for i, h in enumerate(windows(t.codes, n).tolist()):
                if literal[i + n] - literal[i] >= LITERAL * n:
                    forms.setdefault(n, {}).setdefault(h, []).append((k, i))
            for i, h in enumerate(windows(t.plain, n).tolist()):
                plain.setdefault(n, {}).setdefault(h, []).append((k, i))
        self.ids = [item for item, _ in rows]
        self.forms, self.plain = ({n: (np.sort(np.fromiter(x, np.uint64, len(x))), x) for n, x in found.items()} for found in (forms, plain))

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, first word, words) of each longest consistent run that is long enough."""
        t = Template(text)
        if len(t.codes) < LEAST:
            return [(item, 0, len(t.codes)) for item in self.short.get(t.plain.tobytes(), ())] if len(t.codes) else []
        met = self._met(self.forms, t.codes)
        for place, starts in self._met(self.plain, t.plain).items():
            met.setdefault(place, set()).update(starts)
        found = [x for (k, shift), starts in met.items() for x in self._runs(t, k, shift, starts)]
        return list(dict.fromkeys(found))

    @staticmethod
    def _met(by_size, codes: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """By item and shift: where the item's windows that the text has begin."""
        out: dict[tuple[int, int], set[int]] = {}
        for n, (hashes, places) in by_size.items():
            own = windows(codes, n)
            if not len(own):
                continue
            near = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            for at in np.flatnonzero(hashes[near] == own).tolist():
                for k, i in places[int(own[at])]:
                    out.setdefault((k, at - i), set()).add(i)
        return out

    def _runs(self, t: Template, k: int, shift: int, starts: set[int]):
        """Longest consistent runs around windows that were met; equal tokens on either side of these belong to them."""
        item = self.templates[k]
        size = len(item.codes)
        need = min(RUN, size)
        lo, hi = max(0, -shift), min(size, len(t.codes) - shift)
        same = item.codes[lo:hi] == t.codes[lo + shift : hi + shift]
        fits = same | (item.plain[lo:hi] == t.plain[lo + shift : hi + shift])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], fits, [False]]).astype(np.int8))).reshape(-1, 2) + lo
        for first, end in edges.tolist():
            if end - first >= need and any(first <= i < end for i in starts):
                for a, b in self._consistent(t, item, shift, first, end):
                    if b - a >= need and (size >= RUN or same[a - lo : b - lo].all() or t.one_case(a + shift, b - a) or self._same_case(t, item, shift, a, b)):
                        yield self.ids[k], a + shift, b - a

    @staticmethod
    def _consistent(t: Template, item: Template, shift: int, first: int, end: int):
        """The longest parts of first to end whose slots are consistent. The part's head is dropped until the next token fits."""
        #: by value of one side, and kind: the last place of each value of the other side
        forth: dict[tuple, dict[tuple, int]] = {}
        back: dict[tuple, dict[tuple, int]] = {}
        slots = [i for i in range(first, end) if item.slots[i]]
        pairs = {i: ((int(item.codes[i]), item.value(i)), (int(item.codes[i]), t.value(i + shift))) for i in slots}
        begin = first
        for i in slots:
            a, b = pairs[i]
            # the last tokens before this one that speak against it
            against = max([j for v, j in forth.get(a, {}).items() if v != b] + [j for v, j in back.get(b, {}).items() if v != a], default=-1)
            if against >= begin:
                yield begin, i
                begin = against + 1
            forth.setdefault(a, {})[b] = i
            back.setdefault(b, {})[a] = i
        yield begin, end

    @staticmethod
    def _same_case(t: Template, item: Template, shift: int, first: int, end: int) -> bool:
        return all(t.bare(i + shift) == item.bare(i) for i in range(first, end))


def _blocks(benchmark: DataFrame):
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        rows.append((r.item_id, r.text))
        size += len(r.text)
        if len(rows) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


HIT = "array<struct<item_id: long, first: long, words: long>>"


def _match(shared):
    def match(batches):
        items = Items(shared.value)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first", pa.int64()), ("words", pa.int64())]))
        for batch in batches:
            place = batch.schema.get_field_index("hits")
            out = []
            for text, before in zip(batch.column("text").to_pylist(), batch.column(place).to_pylist(), strict=True):
                out.append(before + [{"item_id": i, "first": a, "words": n} for i, a, n in items.hits(text)])
            columns = [pa.array(out, kind) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return match


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: doc_id, mark (tells texts apart) and hits, of all blocks of the benchmark."""
    rows = texts(docs).withColumn("mark", text_key()).withColumn("hits", F.array().cast(HIT))
    share = docs.sparkSession.sparkContext.broadcast
    for block in _blocks(benchmark):
        rows = rows.mapInArrow(tidy(_match(share(block))), f"doc_id long, text string, mark long, hits {HIT}")
    return rows.select("doc_id", "mark", "hits")


def _clean(shared):
    def clean(batches):
        items = Items(shared.value)
        for batch in batches:
            kept = [not items.hits(t or "") for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    for block in _blocks(benchmark):
        docs = docs.mapInArrow(tidy(_clean(docs.sparkSession.sparkContext.broadcast(block))), docs.schema)
    return docs


def op5_query(spark, sf_dir):
    """doc_id, contaminated, n_items, item_ids (ascending) and n_matched (words of the longest run)."""
    hits = benchmark_hits(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    longest = F.coalesce(F.array_max(F.transform("hits", lambda h: h["words"])), F.lit(0).cast("long"))
    return hits.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), longest.alias("n_matched"))
