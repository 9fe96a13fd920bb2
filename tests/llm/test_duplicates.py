import random
from collections import Counter, defaultdict

from sparkloom.llm import ngram_join, relative_lz
from sparkloom.llm.components import connected_components
from tests.llm.conftest import prose


def removed(rows, window):
    first = {}
    for r in rows:
        words = (r[1] or "").encode().split()
        if r[0] is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r in rows:
        words = (r[1] or "").encode().split()
        gone = set()
        if r[0] is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i : i + window])] < r[0]:
                    gone |= set(range(i, i + window))
        out.append((r[0], len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=repr)


def test_repeats_on_odd_rows(odd, odd_rows, none):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in relative_lz.remove_repeats(odd).collect()), key=repr)
    assert got == removed(odd_rows, 50)
    assert relative_lz.remove_repeats(none).count() == 0


def test_repeats_of_all_kinds(spark):
    """Passages cut, joined and shifted, over few words, so that edges of factors and equal hashes abound."""
    r = random.Random(7)
    pool = [r.choice("a b c d e f g h".split()) for _ in range(300)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(r.randint(1, 4)):
            at = r.randint(0, 250)
            words += pool[at : at + r.randint(5, 120)] if r.random() < 0.7 else [r.choice("xyzuvw") for _ in range(r.randint(1, 40))]
        rows.append((r.randint(0, 40), " ".join(words)))
    rows += [(90, "z " * 300), (91, "z " * 200), (92, "z " * 49)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for window in (20, 50):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in relative_lz.remove_repeats(df, window).collect()), key=repr)
        assert got == removed(rows, window)


def test_factors(spark):
    """Factors stand in their reference word for word, an earlier document; none can go on there; with literals and boundaries they
    give the text again."""
    r = random.Random(17)
    pool = prose(3, 900).split()
    rows = []
    for k in range(50):
        words = []
        for _ in range(r.randint(1, 5)):
            at = r.randint(0, 800)
            words += pool[at : at + r.randint(10, 200)] if r.random() < 0.7 else prose(1000 + k, r.randint(1, 30)).split()
        rows.append((k, " ".join(words)))
    out = {x.doc_id: x for x in relative_lz.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 20).collect()}
    words = {k: t.split() for k, t in rows}
    n_factors = 0
    for k, x in out.items():
        gone, behind = set(), 0
        for f in x.factors:
            own, ref = words[k], words[f.ref_doc]
            assert f.ref_doc < k and f.words >= 20 and f["first"] >= behind
            assert own[f["first"] : f["first"] + f.words] == ref[f.ref_first : f.ref_first + f.words]
            gone |= set(range(f["first"], f["first"] + f.words))
            behind = f["first"] + f.words
            n_factors += 1
        for b in x.boundaries:
            assert not gone & set(range(b["first"], b["first"] + b.words))
            gone |= set(range(b["first"], b["first"] + b.words))
        assert len(gone) == x.n_removed and " ".join(w for i, w in enumerate(words[k]) if i not in gone) == x.kept_text
    assert n_factors > 50


def test_greedy_parse():
    """Against trying all stretches at each place."""
    r = random.Random(5)
    for _ in range(300):
        met = [(f, f + r.randint(0, 6), r.randint(0, 2), 0, r.randint(0, 8)) for f in (r.randint(0, 40) for _ in range(r.randint(0, 12)))]
        held = relative_lz.stretches(met, 4)
        want, place = [], 0
        while any(e >= place for _, e, _, _ in held):
            here = [(e, s, ref - f) for f, e, s, ref in held if f <= place <= e]
            if not here:
                place = min(f for f, _, _, _ in held if f > place)
                continue
            end = max(e for e, _, _ in here)
            source, shift = min((s, d) for e, s, d in here if e == end)
            want.append((place, end + 4 - place, source, place + shift))
            place = end + 4
        assert relative_lz.greedy_factors(held, 4) == want
        single = {(w, w + ref - f, doc) for f, e, doc, _, ref in met for w in range(f, e + 1)}
        assert {(w, w + ref - f, s[0]) for f, e, s, ref in held for w in range(f, e + 1)} == single
        # joined as far as they go
        assert all((e + 1, e + 1 + ref - f, s[0]) not in single for f, e, s, ref in held)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 90)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in touched}


def linked(rows, threshold=0.8):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    holders = defaultdict(list)
    n, root = Counter(), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        common = Counter(o for x in s for o in holders[x])
        for o, c in common.items():
            if c >= threshold * (len(s) + len(sets[o]) - c) - 1e-9:
                n[k] += 1
                n[o] += 1
                a, b = top(k), top(o)
                root[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(k)
    low = lambda d: (d is not None, d or 0)
    least = {}
    for k, r in enumerate(rows):
        least[top(k)] = min(least.get(top(k), r[0]), r[0], key=low)
    return sorted(((r[0], least[top(k)], n[k]) for k, r in enumerate(rows)), key=repr)


def test_near_duplicates(odd, odd_rows, none):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(odd).collect()), key=repr)
    assert got == linked(odd_rows)
    assert ngram_join.near_duplicates(none).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len({top for _, top, _ in linked([(k, *r[1:]) for k, r in enumerate(odd_rows)])})


def test_large_groups_in_blocks(spark, monkeypatch):
    r = random.Random(4)
    rows = []
    for g in range(3):
        base = prose(g, 90).split()
        for _ in range(120 if g == 0 else 25):
            words = list(base)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = prose(r.randrange(10**6), 1)
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = linked(rows)
    for block in (2048, 16):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "VALUES_BLOCK", block)
        monkeypatch.setattr(ngram_join, "BROADCAST_SETS", 0 if block == 16 else 500_000)
        got = sorted(((x.doc_id, x.class_id, x.n_links) for x in ngram_join.near_duplicates(df).collect()), key=repr)
        assert got == want
        # classes alone are found by stars and what these leave out
        got = sorted((x.doc_id, x.class_id) for x in ngram_join.near_duplicates(df, links=False).collect())
        assert got == sorted((d, c) for d, c, _ in want)


def test_stars_of_wide_groups(spark, monkeypatch):
    """Chains, in which most members are far from the hub, and many copies around it."""
    r = random.Random(8)
    rows = []
    for g in range(4):
        words = prose(g, 200).split()
        for k in range(40):
            rows.append((len(rows), " ".join(words)))
            if g < 2 or k % 5 == 0:
                for _ in range(3):
                    words[r.randrange(len(words))] = prose(r.randrange(10**6), 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "VALUES_BLOCK", 9)
    want = linked(rows)
    assert len({c for _, c, _ in want}) < 40
    assert sorted((x.doc_id, x.class_id) for x in ngram_join.near_duplicates(df, links=False).collect()) == sorted((d, c) for d, c, _ in want)
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in ngram_join.near_duplicates(df).collect()) == sorted(want)


def test_groups_with_empty_blocks(spark, monkeypatch):
    rows = []
    for g in range(30):
        words = prose(g, 90).split()
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words[:-1], "changed"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "RUNS_BLOCK", 100)
    got = sorted(((x.doc_id, x.class_id, x.n_links) for x in ngram_join.near_duplicates(df).collect()), key=repr)
    assert got == linked(rows) and {n for _, _, n in got} == {1}


def test_least_matches():
    need = ngram_join.least_matches(0.8, 1e-6)
    assert len(need) == ngram_join.HASHES // ngram_join.STEP and need == sorted(need) and need[-1] < 0.8 * ngram_join.HASHES
