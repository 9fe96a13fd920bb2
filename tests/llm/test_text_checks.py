import random
import re

import duckdb
import numpy as np

from sparkloom.llm import decontaminate, pii, quality

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def spans_of(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
            fits = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and double % 10 == 0, "phone": lambda: 9 <= len(digits) <= 15}  # noqa: B023
            if fits[kind]():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    r = random.Random(11)
    for _ in range(6000):
        text = "".join(r.choice("01259..@@+- ()aZ_%é漢\n") for _ in range(r.randint(0, 30)))
        assert pii.base_spans(text) == spans_of(text), text
    card = "4111 1111 1111 1111"
    for text in (f"a {card} b", "0000.1.2.3 001.002.003.004", "a@b.c_d@e.f@g.h", "1" * 5000, "@" * 50 + "a@b.c", "x@y.z." * 20):
        assert pii.base_spans(text) == spans_of(text), text


def test_patterns_find_more(spark, odd, odd_rows, none):
    seen = [f"please call member no {kind} today, said {k}" for k, kind in enumerate(x for x in map(str, range(4111111111111111, 4111111111111211)) if pii.luhn(x))]
    rows = [(k, t, "c") for k, t in enumerate(seen)] + [(110, "please call member no AB-99-X17 today or 77-88", "c"), (111, "the AB-99-X17 is nothing", "c"), (112, None, "c")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()}
    assert [(s.start, s.end, s.kind) for s in got[110].found] == [(22, 31, 2)] and not got[111].found and not got[112].found and not got[0].found
    out = pii.find_personal_data(odd).collect()
    assert sorted(repr((r.doc_id, [(s.start, s.kind, s.end) for s in r.base])) for r in out) == sorted(repr((r[0], spans_of(r[1] or ""))) for r in odd_rows)
    assert pii.find_personal_data(none).count() == 0


def test_second_order_patterns(spark):
    """What a pattern finds makes a pattern of another context, which finds what stood nowhere else."""
    cards = [x for x in map(str, range(4111111111111111, 4111111111111300)) if pii.luhn(x)][:8]
    ids = [f"QX-{k}-{k * 7}" for k in range(10, 22)]
    rows = [f"please call member no {c} today" for c in cards] + [f"please call member no {i} today" for i in ids]
    rows += [f"filed under {i} by staff" for i in ids] + ["filed under ZZ-5-1 by staff", "nothing here ZZ-5-1 at all"]
    # ordinary words stand in this context as often as identifiers do
    rows += [f"walk along {c} now" for c in cards] + [f"walk along {w} now" for w in ("road", "river", "shore", "wall", "street", "lane", "way", "path")] + ["walk along K9 now"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    for limit in (pii.BROADCAST_CONTEXTS, 0):
        pii.BROADCAST_CONTEXTS, kept = limit, pii.BROADCAST_CONTEXTS
        try:
            got = {r.doc_id: [rows[r.doc_id][s.start : s.end] for s in r.found or ()] for r in pii.find_personal_data(df).collect()}
        finally:
            pii.BROADCAST_CONTEXTS = kept
        assert [got[8 + k] for k in range(12)] == [[i] for i in ids] == [got[20 + k] for k in range(12)]
        assert got[32] == ["ZZ-5-1"] and got[33] == [] and all(got[k] == [] for k in (*range(8), *range(34, len(rows))))


def test_spans_beyond_base(spark):
    """The secrets of the driver's table stand behind 'token = ': all are found, nothing else is."""
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    planted = {(d, m.start(1), m.end(1)) for d, t in rows for m in re.finditer('(?i)token = "([0-9a-f]{40})"', t)}
    out = pii.op1_query(spark, sf).collect()
    base = {r.doc_id: spans_of(dict_of[r.doc_id]) for dict_of in [dict(rows)] for r in out}
    more = set()
    for r in out:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        own = {(BASE[k][0], a, b) for a, k, b in base[r.doc_id]}
        assert own <= set(spans)
        more |= {(r.doc_id, a, b) for k, a, b in spans if (k, a, b) not in own}
    assert len(planted) > 100 and more == planted


def test_contexts():
    """Against a plain reading of the words around each one."""
    text = "alpha Beta, gamma\n\nx1 = y2 z\n one two three four five six"
    near, left, last, line = pii.Contexts(text).all()
    lines = [x.split() for x in text.split("\n")]
    words = [w for x in lines for w in x]
    h = [pii._plain(w) for w in words]
    place = [(x, k) for x in lines for k in range(len(x))]
    for i in range(len(words)):
        at = lambda k: np.array([h[k] if 0 <= k < len(h) else 0], np.uint64)
        l2, l3, l1 = (int(x[0]) for x in pii.contexts_of(at(i - 2), at(i - 1), at(i + 1)))
        assert (l3, l2, l1) == (near[i], left[i], last[i])
        assert (line[i] != 0) == (1 <= place[i][1] <= 4)
    assert pii._plain("Beta,") == pii._plain("beta") and pii._plain("x1") == pii._plain("y22") != pii._plain("xy")
    found = [(text[a:b], k) for text in ('the key="ab12" (c3) d@e ' + "0a" * 16,) for a, b, k in pii.occurrences(text, [])]
    assert found == [("ab12", -1), ("c3", -1), ("d@e", -1), ("0a" * 16, pii.SECRET)]


ITEMS = [(1, "A train leaves Paris at 14 km per hour and returns to Paris after 20 minutes, how far did it go in total?"), (2, "Name the largest river that flows through the old town today"), (3, "too short"), (4, None)]


def test_templates(spark, odd, none):
    docs = [
        (1, "intro words. " + ITEMS[0][1] + " end"),
        (2, "A train leaves Rome at 99 miles per hour and returns to Rome after 7 hours, how far did it go in total?"),
        (3, "A train leaves Rome at 99 miles per hour and returns to Oslo after 7 hours"),
        (4, "A train leaves Rome at 5 km per hour but never returns to Rome after that, how far did it go in"),
        (5, "they said NAME: the largest river that flows through the old town today!"),
        (6, None),
        (7, "too short"),
        (8, "The Train Leaves Paris"),
    ]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, hits int")
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")
    hits = {r.doc_id: {h.item_id for h in r.hits} for r in decontaminate.benchmark_hits(df, bench).collect()}
    # an item of under six words is met by a text that has nothing else
    assert hits == {1: {1}, 2: {1}, 3: set(), 4: set(), 5: set(), 6: set(), 7: {3}, 8: set()}
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {3, 4, 5, 6, 8}
    assert decontaminate.benchmark_hits(none, bench).count() == 0
    assert decontaminate.drop_contaminated(odd, bench).count() == odd.count()
    assert decontaminate.benchmark_hits(odd, bench.limit(0)).where("size(hits) > 0").count() == 0


def test_copies_in_another_case(spark):
    german = "Große Straßen führen alle nach Rom und Oslo"
    bench = spark.createDataFrame([*ITEMS, (5, german)], "item_id long, text string")
    docs = [(10 * i + k, f"Intro WORDS {f(t)} end") for i, t in ((1, ITEMS[0][1]), (2, ITEMS[1][1]), (5, german)) for k, f in enumerate((str.upper, str.lower, str.title))]
    docs.append((13, ITEMS[0][1].swapcase()))
    df = spark.createDataFrame([*docs, (90, ITEMS[0][1].upper().replace("LEAVES", "X").replace("MINUTES", "X"))], "doc_id long, text string")
    hits = {r.doc_id: {h.item_id for h in r.hits} for r in decontaminate.benchmark_hits(df, bench).collect()}
    assert hits == {d: {d // 10} for d, _ in docs} | {90: set()}
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {90}


def test_blocks_of_the_benchmark(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = {(r.doc_id, h.item_id) for r in decontaminate.benchmark_hits(docs, bench).collect() for h in r.hits}
    joined = lambda t: " ".join(t.split())
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    assert {(d, i) for d, t in rows for i, x in items if joined(x) in joined(t)} <= whole
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert {(r.doc_id, h.item_id) for r in decontaminate.benchmark_hits(docs, bench).collect() for h in r.hits} == whole
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in whole}


def brute_hits(items, text):
    """All consistent runs, by trying every part of every overlap that holds a window of either kind."""
    D, out = decontaminate, set()
    t = D.Template(text)
    for item, own in items:
        w = D.Template(own)
        n, need = min(D.WINDOW, len(w.codes)), min(D.RUN, len(w.codes))
        for shift in range(-len(w.codes) + need, len(t.codes) - need + 1):
            here = [i for i in range(len(w.codes)) if 0 <= i + shift < len(t.codes)]
            best = []
            for a in here:
                for b in range(a + need, here[-1] + 2):
                    part = range(a, b)
                    if not all(w.codes[i] == t.codes[i + shift] or w.plain[i] == t.plain[i + shift] for i in part):
                        break
                    pairs = {(int(w.codes[i]), w.value(i), t.value(i + shift)) for i in part if w.slots[i]}
                    if len({p[:2] for p in pairs}) < len(pairs) or len({(p[0], p[2]) for p in pairs}) < len(pairs):
                        break
                    best.append((a, b))
            for a, b in best:
                if any((c, d) != (a, b) and c <= a and d >= b for c, d in best):
                    continue
                stretch = [a, b]  # windows count anywhere in the stretch of fitting tokens
                fits = lambda i: 0 <= i < len(w.codes) and 0 <= i + shift < len(t.codes) and (w.codes[i] == t.codes[i + shift] or w.plain[i] == t.plain[i + shift])  # noqa: B023, E731
                while fits(stretch[0] - 1):
                    stretch[0] -= 1
                while fits(stretch[1]):
                    stretch[1] += 1
                window = lambda i: (all(w.codes[j] == t.codes[j + shift] for j in range(i, i + n)) and sum(~w.slots[i : i + n]) >= D.LITERAL * n) or all(w.plain[j] == t.plain[j + shift] for j in range(i, i + n))  # noqa: B023, E731
                if any(window(i) for i in range(stretch[0], stretch[1] - n + 1)):
                    out.add((item, a + shift, b - a))
    return out


def test_runs_against_every_part():
    r = random.Random(12)
    words = "the red Anna Boris Oslo 12 40 km box of in".split()
    for _ in range(150):
        own = [r.choice(words) for _ in range(r.randint(13, 26))]
        text = [r.choice(words) for _ in range(r.randint(0, 6))] + own + [r.choice(words) for _ in range(r.randint(0, 6))]
        swap = {"Anna": r.choice(["Anna", "Carla"]), "12": r.choice(["12", "77"]), "Oslo": r.choice(["Oslo", "OSLO", "Rome"])}
        text = [swap.get(x, x) for x in text]
        for _ in range(r.randint(0, 2)):
            text[r.randrange(len(text))] = r.choice([*words, "Rome", "13"])
        items = [(1, " ".join(own))]
        assert set(decontaminate.Items(items).hits(" ".join(text))) == brute_hits(items, " ".join(text)), (own, text)


def test_what_must_not_be_lost():
    curie = "In what year did Marie Curie win her first Nobel Prize in Physics"
    assert decontaminate.Items([(1, curie)]).hits(f"so: {curie}?") == [(1, 1, 13)]
    # one conflict, of the first token with the thirteenth: all but the first token is consistent
    own = "Anna went out to buy some old red apples at the shop Anna likes and came back late with none at all today"
    other = "Carla went out to buy some old red apples at the shop Dora likes and came back late with none at all today"
    assert decontaminate.Items([(1, own)]).hits(other) == [(1, 1, 22)]
    assert decontaminate.Items([(1, "too short")]).hits("Too Short!") == [(1, 0, 2)] and not decontaminate.Items([(1, "too short")]).hits("it is too short")


def test_query_against_its_parts(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    got = {r.doc_id: (r.contaminated, r.n_items, list(r.item_ids), r.n_matched) for r in decontaminate.op5_query(spark, sf).collect()}
    holds = {d for d, t in rows for _, x in items if " ".join(x.split()) in " ".join(t.split())}
    near = sorted(holds)[:6] + [d for d, _ in rows if d not in holds][:30]
    short = {d: t for d, t in rows}
    for d in near:
        text = short[d]
        if len(text.split()) < 400:
            want = brute_hits(items, text)
            found = sorted({i for i, _, _ in want})
            assert got[d] == (bool(want), len(found), found, max((n for _, _, n in want), default=0))


def test_items_dense_in_slots():
    items = [(1, "12 + 7 = 19 and 30 - 4 = 26 and 8 * 9 = 72"), (2, "Did Anna meet Boris in Oslo?"), (3, "Anna Boris Carla Dario Elena Fritz Greta Heinz Irene Jonas Karla Linus Marta"), (4, "a box of 40 red and green marbles 5 6 7 8 9 10 11 12")]
    index = decontaminate.Items(items)
    for item, text in items:
        assert {h[0] for h in index.hits(f"intro {text} end")} == {item}
    # under 13 words by templates (11) and by plain words (12), 16 by both
    assert index.hits(items[3][1].replace("40", "41")) == [(4, 0, 16)]
    assert index.hits("Did ANNA meet Boris in Oslo?") == index.hits("Did Anna meet Carla in Oslo?") == []


def test_query_over_blocks(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(decontaminate.op5_query(spark, sf).collect())
    assert len(whole) == spark.read.parquet(f"{sf}/documents.parquet").count() and any(r.contaminated for r in whole)
    n = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", -(-n // 3))
    assert sorted(decontaminate.op5_query(spark, sf).collect()) == whole


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in quality.op3_query(spark, sf).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall()
    held = [(out[d].predicted, q) for d, q in labels if out[d].held_out]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_quality_of_odd_rows(spark, odd, odd_rows, none):
    rows = quality.features(odd)
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 1), (7, 1), (2, 0), (3, 0), (10, 0), (None, 1), (8, None)], "doc_id long, quality int")
    model = quality.fit(rows.join(labels, "doc_id"))
    assert quality.score(rows, model).count() == len(odd_rows)
    assert quality.score(quality.features(none), quality.fit(quality.features(none).join(labels, "doc_id"))).count() == 0
    one = quality.fit(rows.join(labels.where("quality = 1"), "doc_id"))
    assert {r.score for r in quality.score(rows, one).collect()} == {1.0}


def test_discriminant_matches_its_formula():
    r = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = {0: r.normal(0, 2, (300, d)), 1: r.normal(1, 1, (500, d))}
    aug = {c: np.concatenate([np.ones((len(v), 1)), v], 1) for c, v in x.items()}
    model = quality.Discriminant({c: a.T @ a for c, a in aug.items()}, to_pooled=0.0, to_diagonal=0.0)
    mean, factor, det, prior = model.classes[1]
    cov = factor @ factor.T
    assert abs(np.linalg.slogdet(cov)[1] - det) < 1e-8 and abs(prior - np.log(500 / 800)) < 1e-12
    q = r.normal(0, 1, (5, d))
    logs = [p - 0.5 * (e + np.einsum("ij,jk,ik->i", q - m, np.linalg.inv(f @ f.T), q - m)) for m, f, e, p in model.classes]
    assert np.allclose(model.score(q), 1 / (1 + np.exp(logs[0] - logs[1])))
