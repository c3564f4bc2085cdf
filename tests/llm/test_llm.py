"""Operators of the llm subpackage against brute force, round trips and held-out truth."""

import random

import numpy as np
import pytest

pytest.importorskip("haatgrid.llm")

from pyspark.sql import functions as F  # noqa: E402

from haatgrid.functions.names import fold, split_name  # noqa: E402
from haatgrid.llm.leaks import align_many, leaked  # noqa: E402
from haatgrid.llm.mixing import entropy, exponent_for_entropy, mix, mix_shares, plan_mix, temper, tempered_targets, token_counter  # noqa: E402
from haatgrid.llm.names import _assignment, align, edits, edits_of_all, index_keys, link_names, name_cost, same_entity_pairs  # noqa: E402
from haatgrid.llm.quantiles import Sketch, merge_sketches, percentiles, rank_error, sketch_groups  # noqa: E402
from haatgrid.llm.subjects import subject_shares  # noqa: E402
from haatgrid.llm.text import plain, sentences, streams, wording  # noqa: E402
from haatgrid.util import cut  # noqa: E402


# percentiles


def _worst(values, sketch, high=True):
    x, worst = np.sort(values), 0.0
    for q in (0.01, 0.1, 0.5, 0.9, 0.99, 0.999):
        got = sketch.quantiles([q])[0]
        lo, hi = np.searchsorted(x, got, "left"), np.searchsorted(x, got, "right")
        want = np.ceil(q * len(x))
        off = 0 if lo < want <= hi else min(abs(lo + 1 - want), abs(hi - want))
        from_end = (len(x) - want + 1) if high else want
        worst = max(worst, off / from_end)
    return worst


@pytest.mark.parametrize("high", [True, False])
def test_sketch_error_is_relative_to_the_protected_end(high):
    rnd = np.random.default_rng(5)
    for values in (rnd.lognormal(7, 1, 200_000), np.arange(100_000.0), np.repeat(np.arange(50.0), 3000)):
        assert _worst(values, Sketch(high=high).add(values), high) <= rank_error()


def test_sketches_of_parts_merge_in_any_order():
    rnd = np.random.default_rng(6)
    parts = [rnd.normal(i % 7, 1, rnd.integers(0, 9000)) for i in range(40)]
    whole = np.concatenate(parts)
    for order in (range(40), reversed(range(40))):
        s = Sketch()
        for i in order:
            s.merge(Sketch.load(Sketch().add(parts[i]).dump()))
        assert s.n == len(whole) and sum(len(x) << h for h, x in enumerate(s.items)) == pytest.approx(len(whole), rel=0.02)
        assert _worst(whole, s) <= rank_error()


def test_small_sketch_is_exact_and_round_trips():
    s = Sketch().add(np.array([3.0, 1.0, 2.0, float("inf")]))
    assert Sketch.load(s.dump()).quantiles([0.25, 0.5, 1.0]) == [1.0, 2.0, float("inf")]
    assert np.isnan(Sketch().quantiles([0.5])[0])


def test_groups_days_and_months(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("ab"), rnd.randrange(6), rnd.gauss(100, 20)) for _ in range(6000)] + [("a", 1, None), ("a", 1, float("nan")), (None, 2, 5.0), ("c", 3, None)]
    df = spark.createDataFrame(data, "g string, day int, v double").repartition(5)
    days = sketch_groups(df, ["g", "day"], "v")
    got = {r["g"]: r for r in percentiles(merge_sketches(days, ["g"]), ["g"]).collect()}
    assert set(got) == {"a", "b", None} and got[None]["p50"] == 5.0
    for g in "ab":
        x = np.sort([v for k, _, v in data if k == g and v is not None and v == v])
        assert got[g]["n"] == len(x)
        for q, c in ((0.5, "p50"), (0.99, "p99")):
            assert abs(np.searchsorted(x, got[g][c]) + 1 - q * len(x)) <= rank_error() * (len(x) * (1 - q) + 1) + 1
    assert sketch_groups(df.limit(0), ["g"], "v").count() == 0


def test_percentiles_keep_their_rank_from_either_end(spark):
    rnd = np.random.default_rng(9)
    n = 200_000
    x = rnd.lognormal(7, 1, n)
    df = spark.createDataFrame([(int(i % 7), float(v)) for i, v in enumerate(x)], "day int, v double").repartition(6).withColumn("g", F.lit("a"))
    shares = (0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999)
    r = percentiles(merge_sketches(sketch_groups(df, ["g", "day"], "v"), ["g"]), ["g"], shares).first()
    s = np.sort(x)
    for q in shares:
        c = f"p{100 * q:g}".replace(".", "_")
        assert r[f"{c}_error"] == pytest.approx(rank_error() * min(q, 1 - q))
        assert abs(np.searchsorted(s, r[c]) + 1 - q * n) <= r[f"{c}_error"] * n + 1
    few = percentiles(sketch_groups(df.limit(100), ["g"], "v"), ["g"]).first()
    assert few["p1_error"] == few["p99_error"] == 0 and few["rank_error"] == rank_error()


# names


def test_edits_and_alignment():
    assert edits("baruramau", "barumarau") == 2 and edits("ab", "ba") == 1 and edits("", "abc") == 3
    assert align(["main", "yard", "navrang"], ["navrang", "main", "yard"]) == 0
    assert align(["n", "central"], ["navrang", "central"]) == 0.5
    assert align(["foo"], ["foo", "khurd"]) == 3.0
    assert name_cost(["baruram", "au"], ["baruramau"]) < 0.5


def test_assignment_of_many_tokens():
    from itertools import permutations

    rnd = random.Random(5)
    for n in (1, 2, 4, 6):
        m = [[rnd.choice((0.0, 0.5, 1.0, 2.5, 9.0)) for _ in range(n)] for _ in range(n)]
        assert _assignment(m) == min(sum(m[i][p[i]] for i in range(n)) for p in permutations(range(n)))
    words = [f"{a}{b}word" for a in "abcde" for b in "vwxyz"]
    assert align(words, words[::-1]) == 0 and align(words, words[1:]) == 2.5 and align([], []) == 0


def test_index_finds_what_the_assignment_accepts():
    rnd, letters = random.Random(12), "abdeghiklmnoprstu"
    tried = found = 0
    for _ in range(3000):
        place = "".join(rnd.choice(letters) for _ in range(rnd.randint(5, 14)))
        other = list(place)
        for _ in range(rnd.randint(1, 3)):
            at = rnd.randrange(len(other))
            other[at : at + 1] = rnd.choice(([], [rnd.choice(letters)], [other[at], rnd.choice(letters)]))
        other = "".join(other)
        if other and name_cost([place], [other]) <= 3.6:
            tried += 1
            found += bool(index_keys(place) & index_keys(other))
    assert tried > 1000 and found >= 0.97 * tried
    assert index_keys("sultanpur lodhi") & index_keys("s lodhi") and index_keys("ambaganj") & index_keys("amba")


def test_link_names(spark):
    reg = spark.createDataFrame([("S", "D", x) for x in ("Ambaganj", "Ambiganj", "Navrang Central (Main Yard)", "Ashosar (Onion)", "Ashosar (Sub Yard)", "Kolanwadi Khurd")], "state string, district string, market string")
    names = [
        (1, "S", "D", "Ambaganj"), (2, "S", "D", "AMBAGANJ APMC"), (3, "S", "Dd", "Ambagnaj"), (4, "S", "D", "Ambiganj"), (5, "S", "D", "Main Yard, Navrang Ctrl"), (6, "S", "D", "Nawrang Central (Main Yd)"),
        (7, "S", "D", "Ashosar (Onoin)"), (8, "S", "D", "Ashosaar Sub Yard"), (9, "S", "D", "Kolanwadi Khd"), (10, "S", "D", "Elsewhere"), (11, "S", "D", "elsewhere APMC"), (12, None, None, None), (13, "S", "D", "Amboganj"),
    ]
    n = spark.createDataFrame(names, "name_id long, state string, district string, market string")
    reports = spark.createDataFrame([("S", "D", "Amboganj", "x", 1), ("S", "D", "Ambaganj", "x", 1), ("S", "D", "Ambiganj", "x", 2), ("S", "D", "Ambaganj", "x", 3)], "state string, district string, market string, series string, day int")
    links = link_names(n, reg, reports)
    got = {r["name_id"]: r["entity"].split("|")[-1] for r in links.collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["Ambaganj", "Ambaganj", "Ambaganj", "Ambiganj"]
    assert got[5] == got[6] == "Navrang Central (Main Yard)" and got[7] == "Ashosar (Onion)" and got[8] == "Ashosar (Sub Yard)" and got[9] == "Kolanwadi Khurd"
    assert got[10] == got[11] and got[13] == "Ambiganj"  # it reports on the same day as Ambaganj
    pairs = {(r["id_a"], r["id_b"]) for r in same_entity_pairs(links).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (4, 13), (5, 6), (10, 11)}
    assert link_names(n.limit(0), reg).count() == 0


def test_names_meet_by_district_not_by_key(spark, monkeypatch):
    """Neither keys nor pairs of a state are shuffled, and districts dealt into several blocks give the same links."""
    from haatgrid.llm import names

    rnd, towns, plans = random.Random(4), ["Duniravar", "Duniraval", "Shahelivar", "Wadatithal", "Goruluvar", "Mehronogarh"], []
    reg = [("S", t, m) for t in towns for m in ("Ambaganj", "Ambiganj", "Kolanwadi", "Sultanpur Lodhi")]
    typed = [(i, "S", (t := list(rnd.choice(towns))) and "".join(t[:-1] if rnd.random() < 0.3 else t), rnd.choice(["Ambagnaj", "Kolanwadi APMC", "S. Lodhi", "Ambeganj", "Nowhere"])) for i in range(60)]
    reg, typed = spark.createDataFrame(reg, "state string, district string, market string"), spark.createDataFrame(typed, "name_id long, state string, district string, market string")
    monkeypatch.setattr(names, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    links = lambda: sorted(map(tuple, link_names(typed, reg).collect()), key=str)
    got = links()
    assert not any("explode(keys" in p for p in plans) and any("FlatMapCoGroupsInArrow" in p for p in plans)
    want = {}
    for i, _, d, m in typed.collect():
        tokens = lambda x: [*(s := split_name(x))[0].split(), *s[1].split()]
        costs = [(0.6 * edits(fold(d.lower()), fold(t.lower())) + name_cost(tokens(m), tokens(x)), f"S|{t}|{x}") for _, t, x in map(tuple, reg.collect()) if index_keys(split_name(m)[0]) & index_keys(split_name(x)[0])]
        want[i] = min([c for c in costs if c[0] <= 3.6], default=None)
    assert {i: (c, e) for i, e, c in got if c is not None} == {i: c for i, c in want.items() if c} and len({i for i, c in want.items() if c}) > 30
    monkeypatch.setattr(names, "BLOCK_ENTITIES", 2)
    monkeypatch.setattr(names, "BLOCK_NAMES", 3)
    assert links() == got


def test_edits_of_many_pairs():
    rnd = random.Random(6)
    a, b = (["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7))) for _ in range(400)] for _ in "ab")
    assert edits_of_all(a, b).tolist() == [edits(x, y) for x, y in zip(a, b)] and edits_of_all([], []).tolist() == [] and edits_of_all([""], [""]).tolist() == [0]


# leaks


def test_a_longer_piece_with_changes_counts():
    item, own = np.arange(60), np.ones(60, np.int16)
    changed = np.arange(30, 46)
    changed[[5, 10]] = 900
    text = np.r_[np.arange(1000, 1030), np.arange(0, 14), np.arange(2000, 2040), changed, np.arange(3000, 3020)]
    score, span = align_many([item], [own], [text])
    assert score[0] == 14 and span[0] == 16
    gap = np.r_[np.arange(0, 14), [901, 902, 903, 904], [18], np.arange(4000, 4010)]
    assert align_many([item], [own], [gap])[1][0] == 14


def test_windows_find_all_of_a_long_text(spark):
    rnd = random.Random(14)
    fill = lambda n: [str(rnd.randrange(10**9)) for _ in range(n)]
    items = [(i, " ".join(fill(80))) for i in range(6)]
    bodies = [t.split() for _, t in items]
    long = fill(505) + bodies[0][:30] + fill(2000) + bodies[1][:14] + fill(450) + bodies[1][20:60] + fill(5000) + bodies[0][50:62] + fill(490) + bodies[2][:16]
    d = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(bodies[3] * 300)), (3, " ".join(fill(600) + bodies[4][:10] + fill(40) + bodies[4][10:20]))], "doc_id long, text string")
    got = {(r["doc"], r["item"]) for r in leaked(d, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (2, 3)}


@pytest.mark.parametrize("share, least", [(0.0, 1.0), (0.1, 0.98), (0.2, 0.8)])
def test_recall_by_share_of_changed_words(spark, share, least):
    rnd = random.Random(15)
    fill = lambda n: [str(rnd.randrange(10**9)) for _ in range(n)]
    items = [(i, fill(60)) for i in range(100)]
    docs = []
    for i, w in items:
        piece = [rnd.choice(([], fill(1), [x, *fill(1)])) if rnd.random() < share else [x] for x in w[10:45]]
        docs.append((i, " ".join([*fill(50), *(y for x in piece for y in x), *fill(50)])))
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc"], r["item"]) for r in leaked(d, "doc_id", "text", it, "item_id", "text").collect()}
    assert len(got) >= least * 100 and all(a == b for a, b in got)


def _brute(a, own, t):
    h = np.zeros((len(a) + 1, len(t) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(t) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (own[i - 1] if a[i - 1] == t[j - 1] else -2.5), h[i - 1, j] - 2.5, h[i, j - 1] - 2.5)
    return h.max()


def test_alignment_against_brute_force():
    rnd = np.random.default_rng(3)
    a = [rnd.integers(0, 4, rnd.integers(1, 25)) for _ in range(30)]
    t = [rnd.integers(0, 4, rnd.integers(1, 40)) for _ in range(30)]
    own = [rnd.integers(0, 2, len(x)).astype(np.int16) for x in a]
    score, span = align_many(a, own, t)
    assert score.tolist() == [_brute(*x) for x in zip(a, own, t)]
    assert (span <= [o.sum() for o in own]).all()


def test_leaks(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    instruction = "answer the question using only what the passage says and nothing else at all"
    items = [(i, f"{instruction}. " + " ".join(word() for _ in range(60))) for i in range(8)]
    body = lambda i: items[i][1].split(". ")[1].split()
    fill = lambda n: " ".join(word() for _ in range(n))
    edited = body(1)[10:40]
    edited[7], edited[20] = "changed", "altered added"
    docs = [
        (1, f"{fill(30)} {' '.join(body(0)[5:30])} {fill(30)}"), (2, f"{fill(9)} " + " ".join(f"[[{w.upper()}]]," if k % 3 else f"'''{w}'''\n" for k, w in enumerate(edited))), (3, f"{fill(30)} {' '.join(body(2)[5:15])} {fill(30)}"),
        (4, f"{fill(20)} {instruction} {fill(20)}"), (5, ""), (6, None), (7, f"{' '.join(body(3)[:20])} {fill(5000)} {' '.join(body(4)[20:50])}"), (8, f"{fill(30)} {' '.join(body(0)[5:30])} {fill(30)}"),
    ]
    docs.append((9, docs[0][1]))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("extra")).withColumn("words", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc"], r["item"]) for r in leaked(d, "doc_id", "text", it, "item_id", "text").collect()}
    assert got == {(1, 0), (9, 0), (8, 0), (2, 1), (7, 3), (7, 4)}
    assert leaked(d.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert leaked(d, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_leaks_inside_markup(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    fill = lambda n: " ".join(word() for _ in range(n))
    items = [(i, fill(60)) for i in range(8)]
    p = [" ".join(t.split()[10:35]) for _, t in items]
    half = p[6].split()
    docs = [
        (0, f"{fill(20)}<ref name=\"a\">{p[0]}</ref> {fill(20)}"), (1, f"{fill(20)} {{{{quote|text={p[1]}|by={{{{x|y}}}}}}}} {fill(9)}"), (2, f"{fill(20)} <!-- {p[2]} --> {fill(9)}"),
        (3, f"[[File:A b.jpg|thumb|{p[3][:60]} [[to|{p[3][61:]}]]]] {fill(9)}"), (4, f"{{{{box|{fill(9)}<ref>{{{{cite|{p[4]}}}}}</ref>}}}}"), (5, f"<ref>{p[5][:80]} <!-- {fill(9)} -->{p[5][80:]}</ref>"),
        (6, f"{' '.join(half[:9])} {{{{lang|{' '.join(half[9:])}}}}} {fill(9)}"), (7, f"{p[7][:80]}<ref>{fill(30)}</ref>{p[7][80:]}"),
    ]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc"], r["item"]) for r in leaked(d, "doc_id", "text", it, "item_id", "text").collect()} == {(i, i) for i in range(8)}


def test_streams_of_text():
    assert streams(None) == [[]] and streams("One two") == [["one", "two"]] and streams("One [[b|two]]") == [["one", "two"]]
    assert streams("a <ref name=x>b {{c|d}} e</ref> f {{g [[h") == [["a", "f", "g", "h"], ["c", "d"], ["b", "e"], ["a", "b", "c", "d", "e", "f", "g", "h"]]
    assert all(streams(x * 100_000) for x in ("{{", "<ref>", "<!--", "[[File:", "{{<ref>}}"))


def test_plain_text():
    assert wording("'''The''' [[Encore (x)|encore]]<ref name=\"a\" />, it's<ref>{{cite|a={{b}}}}</ref> &amp; {{t|x}}[[word]]<!-- no -->.") == ["the", "encore", "its", "word"]
    assert plain(None) == "" and plain("{{open [[a") == "{{open [[a"
    assert sentences("#REDIRECT [[A]]") == [] and sentences("== Head ==\n* list item here\nOne two three. Four five six!\n{|\n| a b c\n|}") == ["One two three.", "Four five six!"]
    assert len(plain("{{" * 200_000)) == 400_000 and len(plain("<ref>" * 100_000)) >= 0 and plain("<!--" * 100_000)


# mixing


def test_plan():
    w, total, e = plan_mix({"a": 1000, "b": 100, "c": 50}, {"a": (0.5, 1), "b": (0.3, 4), "d": (0.2, 9)})
    assert w == pytest.approx({"a": 0.625, "b": 0.375}) and total == pytest.approx(400 / 0.375) and e == 0
    w, total, e = plan_mix({"a": 1000, "b": 100}, {"a": (0.5, 1), "b": (0.5, 2)}, 900)
    assert 0 < e < 1 and total == 900 and w["b"] * 900 == pytest.approx(200) and w["a"] * 900 <= 1000
    assert plan_mix({}, {"a": (1.0, 1)}) == ({}, 0.0, 0.0)


def test_tempering_meets_an_entropy():
    p = {"a": 0.9, "b": 0.09, "c": 0.01}
    e = exponent_for_entropy(p, 0.8)
    assert entropy(temper(p, e)) == pytest.approx(0.8, abs=1e-6)
    assert temper(p, 1) == pytest.approx(p) and max(temper(p, 0).values()) == pytest.approx(1 / 3)


def test_mix(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a"] * 8 + ["b", None, "z"]), rnd.randint(0, 50)) for i in range(4000)] + [(9000, "b", None)]
    docs = cut(spark.createDataFrame(rows, "id long, source string, size long"))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = mix(docs, "id", "source", "size", t, blocks=16).collect()
    assert {r["source"] for r in got} == {"a", "b"} and max(r["repeats"] for r in got if r["source"] == "b") <= 3 and max(r["repeats"] for r in got if r["source"] == "a") == 1
    shares = {r["source"]: r for r in mix_shares(mix(docs, "id", "source", "size", t, blocks=16), t).collect()}
    assert shares["b"]["share"] == pytest.approx(4 / 9, abs=0.01) and shares["gone"]["tokens"] == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs, "id", "source", "size", t, blocks=16).collect()))
    assert mix(docs.limit(0), "id", "source", "size", t).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("a" * 20000,)], "t string")
    got = [r["n"] for r in df.select(token_counter()("t").alias("n")).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 100


# subjects


def test_subjects_of_made_documents(spark):
    rnd = random.Random(9)
    nouns = {s: [f"{s}{x}" for x in "abcdefgh"] for s in ("law", "sport", "music")}
    frames = ("The {} and the {} were both described in {y}.", "Without the {}, neither the {} nor the weather would have lasted.", "A {} without a {} was long thought impossible.")
    none = ("It was renamed in {y} and again later.", "Little is known about the years before {y}.", "The matter is still discussed there.")

    def text(parts):
        out = [rnd.choice(frames).format(*rnd.choices(nouns[s], k=2), y=rnd.randint(1500, 1999)) for s, n in parts for _ in range(n)] + [rnd.choice(none).format(y=1700) for _ in range(2)]
        rnd.shuffle(out)
        return "\n\n".join(out)

    docs, labels, truth = [], [], set()
    for i in range(240):
        a, b = rnd.sample(list(nouns), 2)
        parts = [(a, 8), (b, 5)] if i % 3 == 0 else [(a, 10), (b, 1)]
        docs.append((i, text(parts)))
        truth |= {(i, s) for s, n in parts if n > 4}
        if i % 2:
            labels.append((i, a))
    docs += [(900, "#REDIRECT [[X]]"), (901, ""), (902, None), (903, "{{t}}")]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")
    x = subject_shares(d, "doc_id", "text", l, "doc_id", "subject").filter("share >= 0.25")
    got = {(r["doc"], r["subject"]) for r in x.collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.03 * len(truth)
    assert subject_shares(d, "doc_id", "text", l.limit(0), "doc_id", "subject").count() == 0
    assert subject_shares(d.limit(0), "doc_id", "text", l, "doc_id", "subject").count() == 0


def test_sentences_of_items_do_not_count_however_many(spark):
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(60):
        s = ("law", "sport")[i % 2]
        docs.append((i, "\n\n".join(f"The {s}{rnd.choice('abcdef')} and the {s}{rnd.choice('abcdef')} were described in {rnd.randint(1500, 1999)}." for _ in range(8))))
        labels.append((i, s))
    item = "The sporta and the sportb were won by nobody in particular. The sportc and the sportd had never been counted by anyone before."
    docs += [(100, docs[0][1] + "\n\n" + "\n\n".join(["The sporta and the sportb were won by nobody in particular."] * 8)), (101, None)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")
    it = spark.createDataFrame([(1, item), (2, ""), (3, None)], "item_id long, text string")
    runs = [{tuple(r) for r in subject_shares(d, "doc_id", "text", l, "doc_id", "subject", it, item_runs=n).collect()} for n in (1_000_000, 0)]
    assert runs[0] == runs[1] and {(r[0], r[1]) for r in runs[0] if r[0] == 100} == {(100, "law")}
    assert any(r[1] == "sport" for r in subject_shares(d, "doc_id", "text", l, "doc_id", "subject").filter("doc = 100").select("doc", "subject").collect())


def test_tempered_targets(spark):
    docs = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10), ("z", 50), (None, 5), ("a", None)], "source string, size long")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 9), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r["target_share"] for r in tempered_targets(docs, "source", "size", t).collect()}
    assert entropy({k: v for k, v in got.items() if v}) == pytest.approx(entropy({"a": 0.5, "b": 0.3, "c": 0.2}), abs=1e-6) and got["a"] > got["b"] > got["c"] and got["gone"] == 0
