import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import length_histogram, nbest_pieces, token_files
from sparkloom.llm.wordpiece import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_words_encode_as_the_library_does(tokenizer):
    r = random.Random(5)
    letters = "aAbBéÉßñçœŒǅİıΣσς漢字áå 12½²'’s't.,!$*|<>-_`~\t\n\x1c\x85\xa0　​" + "xyz "
    texts = ["", " ", "it's I'LL 'd ''s a'b", "<|endoftext|> x<|startoftext|>y <|en"] + ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(800)]
    for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder(PATH).encode(t), "<u2").tolist() == e.ids, t


def test_pack():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 1 << 32, n, np.uint64) >> r.integers(0, 32, n, np.uint64)).astype(np.uint32)
        control, data = token_files.pack(x)
        assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == x).all()


def test_packing_takes_little_memory():
    """Numbers of one and two bytes, as ranks are, take few bytes of arrays each, on both ways; those of more are packed as well."""
    r = np.random.default_rng(2)
    n = 1 << 18
    for width, limits in ((2, (14, 22)), (4, (24, 24))):
        x = (r.integers(0, 1 << 8 * width, n, np.uint64) >> r.integers(0, 8 * width, n, np.uint64)).astype(np.uint32)
        x[:6] = [0, 255, 256, 65535, 65536 % (1 << 8 * width), (1 << 8 * width) - 1]
        peaks, results = [], []
        for run in (lambda x=x: token_files.pack(x), lambda: token_files.unpack(*results[0], n)):
            tracemalloc.start()
            results.append(run())
            peaks.append(tracemalloc.get_traced_memory()[1] / n)
            tracemalloc.stop()
        assert (results[1] == x).all()
        sizes = 1 + (x > 0xFF).astype(int) + (x > 0xFFFF) + (x > 0xFFFFFF)
        assert results[0] == (bytes(((sizes - 1).reshape(-1, 4) << [0, 2, 4, 6]).sum(1).tolist()), b"".join(v.to_bytes(k, "little") for v, k in zip(x.tolist(), sizes.tolist(), strict=True)))
        assert peaks[0] < limits[0] and peaks[1] < limits[1], peaks


def test_ids_are_counted_while_they_are_encoded(tokenizer, monkeypatch):
    """A task gives how often each id occurs beside the ids, so that nothing is read again to count them."""
    import pyarrow as pa

    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    texts = ["", "one two, Two", "x" * 300, "a b c d e f g " * 30]
    batches = [pa.RecordBatch.from_arrays([pa.array([k, k]), pa.array([t, "last"])], ["doc_id", "text"]) for k, t in enumerate(texts)]
    rows = [r for b in token_files._encode(PATH, 1)(batches) for r in b.to_pylist()]
    told = [r for r in rows if r["counts"] is not None]
    want = Counter(i for t in texts for x in (t, "last") for i in [*tokenizer.encode(x, add_special_tokens=False).ids, 1])
    assert len(rows) == 9 and told == rows[-1:] and told[0]["doc_id"] is told[0]["ids"] is None
    assert {i: n for i, n in enumerate(np.frombuffer(told[0]["counts"], "<i8").tolist()) if n} == want
    twice = pa.RecordBatch.from_arrays([pa.array([r["counts"] for r in told * 2])], ["counts"])
    assert {r["id"]: r["n"] for b in token_files._sum_counts([twice]) for r in b.to_pylist()} == {i: 2 * n for i, n in want.items()}
    assert list(token_files._encode(PATH, 1)([])) == []


def test_words_of_letters_and_signs(tokenizer):
    """Every sign of ASCII and Latin-1 behind, before and between letters, in either case."""
    signs = [chr(c) for c in range(0x21, 0x100) if not chr(c).isspace()]
    words = [w for c in signs for w in (c, "a" + c, c + "B", "Caf\xc9" + c, "a" + c + "b", "Ab" + c + ".", "\xdf\xaa" + c + c)]
    for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder(PATH).encode(w), "<u2").tolist() == e.ids, w


def expected(rows, tokenizer):
    out, start = [], 0
    coded = [(-(1 << 63) if r[0] is None else r[0], np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u2").tobytes(), r[0]) for r in rows]
    for _, ids, doc in sorted(coded, key=lambda x: x[:2]):
        n = len(ids) // 2
        out.append((doc, start, n, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())))
        start += n
    return out


def test_token_files(odd, odd_rows, none, tokenizer, monkeypatch):
    files = token_files.TokenFiles.write(odd, PATH, partitions=3)
    got = sorted((tuple(r) for r in files.read().collect()), key=lambda r: r[1])
    assert got == expected(odd_rows, tokenizer)
    ranks = {r.id: r["rank"] for r in files.ranks.collect()}
    assert sorted(ranks.values()) == list(range(len(ranks)))
    assert token_files.TokenFiles.write(none, PATH).read().count() == 0


def test_token_files_at_a_path(spark, odd, odd_rows, tokenizer, tmp_path):
    path = f"file://{tmp_path}/set"
    token_files.TokenFiles.write(odd, PATH, path, partitions=4)
    files = token_files.TokenFiles.open(spark, path)
    want = expected(odd_rows, tokenizer)
    assert sorted((tuple(r) for r in files.read().collect()), key=lambda r: r[1]) == want
    assert sum(r.n for r in files.ranks.collect()) == sum(w[2] for w in want) == sum(r.n_ids for r in files.parts.collect())
    # decoded by hand, from the files alone
    ids = {r["rank"]: r.id for r in files.ranks.collect()}
    got = [ids[k] for b in sorted(files.blocks.collect(), key=lambda b: (b.part, b.block)) for k in token_files.unpack(bytes(b.control), bytes(b.data), b.n_ids).tolist()]
    assert [zlib.crc32(np.array(got[w[1] : w[1] + w[2]], "<u4").tobytes()) for w in want] == [w[3] for w in want]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        token_files.TokenFiles.write(odd, PATH, path)
    with pytest.raises(FileNotFoundError):
        token_files.TokenFiles.open(spark, f"file://{tmp_path}/other")


def test_queries_of_tokens(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in token_files.op10_query(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == expected(rows, tokenizer)
    n = [x[2] - 1 for x in got]
    sums = {tuple(r) for r in length_histogram.op7_query(spark, sf).collect()}
    assert sums == {(k, n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n)) for k in set(n)}
    m = nbest_pieces.model(nbest_pieces.default_model())
    for r in nbest_pieces.op9_query(spark, sf).collect():
        text = dict(rows)[r.doc_id]
        best, ways = m.encode(text, 3)
        crc = [zlib.crc32(m.swapped(best, w).astype("<u4").tobytes()) for _, w in ways]
        assert (r.n_pieces, r.text_crc32, r.ways_decode) == (len(best) // 2, zlib.crc32(text.encode()), True)
        assert [r.score, r.score_2, r.score_3][: len(ways)] == [s for s, _ in ways] and [r.ids_crc32, r.ids_crc32_2, r.ids_crc32_3][: len(ways)] == crc


def test_word_cache_starts_anew(tokenizer, monkeypatch):
    from sparkloom.llm import wordpiece

    monkeypatch.setattr(wordpiece, "CACHE_BYTES", 2_000)
    e = wordpiece.WordEncoder(PATH)
    for k in range(200):
        text = f"word{k} other{k}, Third{k}"
        assert np.frombuffer(e.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids and e.held < 5_000


def test_lengths(odd, odd_rows, none, tokenizer):
    n = [len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows]
    sums = length_histogram.suffix_sums(length_histogram.histogram(length_histogram.token_counts(odd, PATH))).cache()
    c = Counter(n)
    assert {tuple(r) for r in sums.collect()} == {(k, c[k], sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n)) for k in c}
    at = {r.context_limit: tuple(r)[1:] for r in length_histogram.totals_at(sums, [0, 7, 100, 10**6]).collect()}
    assert at == {k: (len(n), sum(n), sum(x > k for x in n), sum(min(x, k) for x in n)) for k in (0, 7, 100, 10**6)}
    ordered = sorted(n)
    assert {r.q: r.n_tokens for r in length_histogram.quantiles(sums, [0.1, 0.5, 1.0]).collect()} == {q: next(x for k, x in enumerate(ordered) if k + 1 >= q * len(n)) for q in (0.1, 0.5, 1.0)}
    assert length_histogram.suffix_sums(length_histogram.histogram(length_histogram.token_counts(none, PATH))).count() == 0


def every(model, text):
    out = []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, tuple(ids)))
            return
        single = False
        for j in range(i + 1, len(text) + 1):
            e = model.entries.get(text[i:j])
            if e:
                single |= j == i + 1
                go(j, score + e[0], [*ids, e[1]])
        if not single:
            go(i + 1, score + model.worst - nbest_pieces.UNKNOWN_COST, [*ids, *text[i].encode()])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("n", [1, 2, 5])
def test_nbest_against_all_segmentations(n):
    r = random.Random(n)
    model = nbest_pieces.PieceModel.of({"a": -2, "b": -3, "ab": -4, "aba": -5.5, " ": -1, " a": -2.5, "ba": -4.5, "bb": -4, " ab": -5})
    for _ in range(200):
        text = "".join(r.choice("aab b\nc") for _ in range(r.randint(0, 9)))
        all_ways = every(model, " " + text)
        best, ways = model.encode(text, n)
        ids = np.frombuffer(best, "<u2").tolist()
        assert [round(s, 6) for s, _ in ways] == [round(s, 6) for s, _ in all_ways[:n]]
        score = {i: s for s, i in all_ways}
        found = [tuple(nbest_pieces.apply_swaps(ids, swaps)) for _, swaps in ways]
        assert len(set(found)) == len(found) and all(abs(score[f] - s) < 1e-6 for f, (s, _) in zip(found, ways, strict=True))
        assert model.decode(best) == text


def test_long_runs_and_ties():
    """Equal letters have ways of equal score without number; time grows with the length."""
    m = nbest_pieces.model(nbest_pieces.default_model())
    began = time.time()
    for text in ("-" * 20_000, "=" * 20_000, " " * 5_000, "x\n" + "*" * 5_000):
        best, ways = m.encode(text, 3)
        assert m.decode(best) == text and len({tuple(m.swapped(best, w).tolist()) for _, w in ways}) == 3
        assert all(m.same_text(best, w) for _, w in ways)
    assert time.time() - began < 30


def test_best_way_is_that_of_both_searches():
    r = random.Random(3)
    model = nbest_pieces.PieceModel.of({"a": -1, "aa": -2, "aaa": -3, "b": -1, "ab": -2, "ba": -2, " ": -1, " a": -2})
    for _ in range(60):
        text = " " + "".join(r.choice("aab") for _ in range(r.randint(1, 12)))
        model.known.clear()
        assert model._viterbi([text], len(text)) == []
        score, ids, loss = model.known[text]
        ways = model.nbest(text, 2)
        assert ways[0] == (score, tuple(np.frombuffer(ids, "<u2").tolist())) and loss == (ways[0][0] - ways[1][0] if len(ways) > 1 else np.inf)


def test_chunks_are_put_together_of_parts(monkeypatch):
    """A word is learned once, whatever signs follow it, and the ways are those of a search over whole chunks."""
    r = random.Random(9)
    model = nbest_pieces.PieceModel.of({"a": -2, "b": -3, "ab": -4, "ba": -4.5, " ": -1, " a": -2.5, ",": -3, "-": -2, ",-": -5.5, " ,": -3.5, "1": -2, "é": -4, "éa": -5})
    learned, viterbi = [], nbest_pieces.PieceModel._viterbi
    monkeypatch.setattr(nbest_pieces.PieceModel, "_viterbi", lambda self, chunks, size: learned.extend(chunks) or viterbi(self, chunks, size))
    for text in ["ab,-1", "1,,-é", " ,ab  -"] + ["".join(r.choice("abé,-1 \nx漢") for _ in range(r.randint(0, 8))) for _ in range(150)]:
        all_ways = every(model, " " + text)
        for n in (1, 3):
            best, ways = model.encode(text, n)
            score = {i: s for s, i in all_ways}
            found = [tuple(model.swapped(best, w).tolist()) for _, w in ways]
            assert model.decode(best) == text and len(set(found)) == len(found) == min(n, len(all_ways))
            assert [round(s, 6) for s, _ in ways] == [round(s, 6) for s, _ in all_ways[:n]] == [round(score[f], 6) for f in found]
    assert len(set(learned)) == len(learned) and not any("a" in c and ("," in c or "1" in c) for c in learned)
    learned.clear()
    words = ["".join(r.choice("abé") for _ in range(9)) for _ in range(300)]
    model.encode(" ".join(w + r.choice(["", ",", ",-", "-,", "1", "-11"]) for w in words * 4), 3)
    assert len(learned) <= len(set(words)) + 4


def test_round_trip_in_one_pass(odd, odd_rows, none):
    path = nbest_pieces.default_model()
    m = nbest_pieces.model(path)
    out = nbest_pieces.round_trip(odd, path).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = []
    for d, text, *_ in odd_rows:
        best, ways = m.encode(text or "", 3)
        ids = np.frombuffer(best, "<u2").tolist()
        assert all(m.decode(np.array(nbest_pieces.apply_swaps(ids, w), "<u2").tobytes()) == (text or "") for _, w in ways)
        want.append((d, len(ids), crc(ids), [crc(nbest_pieces.apply_swaps(ids, w)) for _, w in ways], zlib.crc32((text or "").encode()), True))
    assert sorted([(r.doc_id, r.n_pieces, r.ids_crc32, list(r.ways_crc32), r.text_crc32, r.ways_decode) for r in out], key=repr) == sorted(want, key=repr)
    assert nbest_pieces.round_trip(none, path).count() == 0


def test_segmentation_round_trip(odd, odd_rows, none):
    path = nbest_pieces.default_model()
    coded = nbest_pieces.segment(odd, path)
    got = sorted((repr(r.doc_id), r.decoded) for r in nbest_pieces.decode(coded.select("doc_id", "ids"), path).collect())
    assert got == sorted((repr(r[0]), r[1] or "") for r in odd_rows)
    assert all(list(r.scores) == sorted(r.scores, reverse=True) for r in coded.collect())
    assert nbest_pieces.segment(none, path).count() == 0
