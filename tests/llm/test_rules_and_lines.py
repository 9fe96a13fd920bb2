import re
from collections import Counter

from sparkloom.llm import host_rules, line_index
from sparkloom.llm.common import stash

SPACE = " \t\n\x0b\x0c\r"


def rules_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeated = {i + o for i, w in enumerate(windows) if count[w] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_statistics(odd, odd_rows):
    got = sorted(tuple(r)[2:] for r in host_rules.document_statistics(odd).collect())
    assert got == sorted(rules_of(r[1]) for r in odd_rows)


def test_repeats_of_many_shapes(spark):
    texts = ["a a a a a a", "a b c a b c", "a b c d a b", "x a b c y a b c z", "a b c a b c a b c d", "", "a", "a b", "a b c", "q " * 5000, "w e r t " * 300 + "u"]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_repeat_words for r in host_rules.document_statistics(df).collect()}
    assert got == {k: rules_of(t)[4] for k, t in enumerate(texts)}


def test_host_verdicts(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, good, f"good{k % 9}") for k in range(90)] + [(1000 + k, "short", "bad") for k in range(40)] + [(2000, good, "bad"), (2001, good, None), (2002, "short", "good1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in host_rules.apply_host_rules(df).collect()}
    assert got[2000] == (False, False) and got[2001] == (False, True) and got[2002] == (True, False) and all(got[k][1] for k in range(90))
    assert host_rules.keep_documents(df).count() == 91
    old, host_rules.BROADCAST_HOSTS = host_rules.BROADCAST_HOSTS, 0
    try:
        assert {r.doc_id: (r.base_failed, r.kept) for r in host_rules.apply_host_rules(df).collect()} == got
    finally:
        host_rules.BROADCAST_HOSTS = old


def test_rules_keep_columns_and_bear_nothing(odd, none):
    kept = host_rules.keep_documents(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {4, 5, 6, 7, 8}
    assert host_rules.apply_host_rules(none).count() == 0 and host_rules.keep_documents(none).count() == 0


def lines_of(rows, least=10):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(SPACE))
    held = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} - {""})
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if held[key(x)] < least or not key(x)]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(odd, odd_rows, none):
    order = lambda x: sorted(x, key=repr)
    want = order(lines_of(odd_rows))
    index = line_index.LineIndex.build(odd)
    assert order(tuple(r) for r in index.prune(odd).collect()) == want
    assert order(tuple(r) for r in index.prune(odd, broadcast_keys=0).collect()) == want
    for limit in (10, 0):
        rewritten = index.rewrite(odd, broadcast_keys=limit)
        assert rewritten.columns == odd.columns
        assert order((r.doc_id, r.text) for r in rewritten.collect()) == order((w[0], None if o[1] is None else w[3]) for w, o in zip(lines_of(odd_rows), odd_rows, strict=True))
    assert line_index.dedup_lines(none).count() == 0


def test_index_is_reversible(spark):
    rows = [(k, f"common\nown {k}\nhalf {k % 2}") for k in range(14)]
    df = lambda x: stash(spark.createDataFrame(x, "doc_id long, text string"))
    keys = lambda i: {bytes(r.key) for r in i.frequent().collect()}
    inside = lambda i: {bytes(k) for k in keys(i) if any(line_index.CuckooFilter.load(bytes(f.filter)).contains(line_index.CuckooFilter.parts([k]))[0] for f in i.filters.collect())}
    first = line_index.LineIndex.build(df(rows[:9]), 8)
    more = first.insert(df(rows[9:]))
    whole = line_index.LineIndex.build(df(rows), 8)
    assert keys(more) == keys(whole) == inside(more) and {tuple(r) for r in more.counts.collect()} == {tuple(r) for r in whole.counts.collect()}
    back = more.delete(df(rows[9:]))
    assert {tuple(r) for r in back.counts.collect()} == {tuple(r) for r in first.counts.collect()} and keys(back) == inside(back)
    emptied = back.delete(df(rows[:9]))
    assert emptied.counts.count() == 0 and all(not any(bytes(f.filter)) for f in emptied.filters.collect())


def test_shards_and_false_affirmations(spark, monkeypatch):
    """Many shards; filters that affirm everything change nothing, filters that deny everything keep all lines."""
    rows = [(k, "\n".join(f"line {k * j % 37}" for j in range(20)) + f"\nown {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(lines_of(rows))
    monkeypatch.setattr(line_index, "SHARD_KEYS", 3)
    index = line_index.LineIndex.build(df)
    assert index.shards > 5
    stored = {r.shard: bytes(r.filter) for r in index.filters.collect()}
    filters = line_index.Filters((index.shards, stored))
    keys = [bytes(r.key) for r in index.frequent().collect()]
    assert filters.affirm(keys).all() and all(line_index.CuckooFilter.load(stored[int.from_bytes(k[:2], "little") % index.shards]).contains(line_index.CuckooFilter.parts([k]))[0] for k in keys)
    for limit in (10_000, 0):
        assert sorted(tuple(r) for r in index.prune(df, broadcast_keys=limit).collect()) == want
    monkeypatch.setattr(line_index, "BROADCAST_FILTERS", -1)
    assert sorted(tuple(r) for r in index.prune(df, broadcast_keys=0).collect()) == want
    monkeypatch.setattr(line_index.Filters, "affirm", lambda self, d: __import__("numpy").ones(len(d), bool))
    checker = line_index._checker(index._shared())
    assert checker(keys + [b"\0" * 16]) == [True] * len(keys) + [False]


def test_cuckoo_filter():
    import numpy as np

    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, (5000, 2), np.uint64) * np.uint64(2)
    f = line_index.CuckooFilter.sized(5000)
    f.insert(keys)
    assert f.contains(keys).all() and f.contains(rng.integers(0, 1 << 63, (5000, 2), np.uint64)).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
