"""The fuzzy filter against all pairs, on names that share rare and common runs of characters."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from quarryline.functions.text import token_set_ratio
from quarryline.operators import fuzzy, resolve


def crowd(seed):
    """Names of few words and letters, so that words, ends and beginnings are common to many."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abemn") for _ in range(rng.randrange(1, 7))) for _ in range(25)] + ["lpha", "mike", "alpha", "zlpha", "supply", "co"]
    return sorted({" ".join(rng.sample(words, rng.randrange(1, 5))) for _ in range(90)})


@pytest.mark.parametrize("floor", [84.0, 75.0, 92.0])
def test_no_pair_at_the_floor_is_lost(spark, floor):
    names = crowd(int(floor)) + [f"{c}lpha{k} mike" for k in range(8) for c in "az"] + ["alpha mike", "zlpha mike", "", "a", "é ü", "mike mike mike"]
    asked = sorted({n[1:] for n in names} | {n + "s" for n in names} | {" ".join(reversed(n.split())) for n in names} | {n.replace(" ", "") for n in names} | set(names))
    query, known = spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(n,) for n in names], "name string")
    pairs = spark.createDataFrame(list(itertools.product(asked, sorted(set(names)))), "asked string, name string").withColumn("score", token_set_ratio("asked", "name"))
    wanted = {(r["asked"], r["name"]) for r in pairs.where(f"score >= {floor}").collect()}
    got = {tuple(r) for r in fuzzy.plausible(query, known, floor).collect()}
    assert wanted <= got and (floor > 90 or ("alpha mike", "zlpha mike") in got)


def test_rivals_below_the_floor_are_seen(spark):
    names = crowd(7)
    asked = [n + "x" for n in names] + ["bosh"]
    known = [*names, "bosch"]
    pairs = spark.createDataFrame(list(itertools.product(asked, known)), "asked string, name string").withColumn("score", token_set_ratio("asked", "name"))
    best = {}
    for r in pairs.collect():
        best.setdefault(r["asked"], []).append((-r["score"], r["name"]))
    got = {r["asked"]: (r["name"], r["verdict"]) for r in fuzzy.matched(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(k,) for k in known], "name string")).collect()}
    for a in asked:
        (first, name), (second, _) = sorted(best[a])[:2]
        verdict = "unresolved" if -first < 88 else "ambiguous" if second - first < 4 else "fuzzy"
        assert got[a] == (name if verdict != "unresolved" else None, verdict)


def test_masters_from_elsewhere(spark):
    rows = spark.createDataFrame(
        [(1, "Bosch", None, "bosch"), (2, "Bosh", None, "bosh"), (3, "BT Tools", None, "bt tools"), (4, "Makta", "MK", "makta"), (5, "Zzz", None, "zzz"), (6, "Acme Pumpx", None, "acme pumpx"), (7, None, None, None)],
        "row_index long, supplier string, code string, supplier_key string",
    )
    master = spark.createDataFrame([("Bosch", "BO", "bosch", ["BT Tools"]), ("Makita", "mk", "makita", None), ("Acme Pumps", None, "acme pumps", []), ("Acme Pumpt", None, "acme pumpt", [])], "name string, code string, supplier_key string, aliases array<string>")
    got = {r["row_index"]: (r["manufacturer"], r["method"], round(r["confidence"], 4)) for r in resolve.resolve_suppliers(rows, master, fuzzily=True, official=True).collect()}
    assert got[1] == ("Bosch", "exact", 0.98) and got[3] == ("Bosch", "alias", 0.92) and got[4] == ("Makita", "code", 0.99)
    assert got[2] == ("Bosch", "fuzzy", round(0.78 * 0.888888, 4)) and got[5] == (None, "unresolved", 0.0)
    assert got[6] == (None, "ambiguous", 0.0) and got[7][1] is None


def test_numbered_names_are_not_met_pair_by_pair(spark, monkeypatch):
    names = [f"supplier {i}" for i in range(12000, 12600)]
    asked = [n.replace("pp", "p") for n in names[::2]]
    proposed, filtered = [], fuzzy.plausible

    def counted(*args):
        found = filtered(*args)
        proposed.append(found.count())
        return found

    monkeypatch.setattr(fuzzy, "plausible", counted)
    got = fuzzy.matched(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert len(got) == len(asked) and all((r["name"], r["verdict"]) == (r["asked"].replace("p", "pp"), "fuzzy") for r in got)
    assert sum(proposed) < 0.5 * len(asked) * len(names)


def test_numbered_names_meet_few_others(spark, monkeypatch):
    met, written = [], fuzzy.settled

    def seen(df, name):
        out = written(df, name)
        if name == "keys":
            met.append(out.where("NOT crowd").groupBy("key").agg((F.count_if("known") * F.count_if(~F.col("known"))).alias("n")).agg(F.sum("n")).first()[0] or 0)
        return out

    monkeypatch.setattr(fuzzy, "settled", seen)
    names = [f"supplier {10000 + i * 90000 // 4000}" for i in range(4000)]
    known = spark.createDataFrame([(x,) for x in names], "name string")
    got = {tuple(r) for r in fuzzy.plausible(known.selectExpr("replace(name, 'pp', 'p') AS asked"), known, 92.0).collect()}
    assert {(x.replace("pp", "p"), x) for x in names} <= got
    assert len(met) > 1 and 0 < sum(met) < 40 * len(names)


def test_similarity_is_that_of_whole_strings():
    def common(x, y):
        row = [0] * (len(y) + 1)
        for p in x:
            row = [0, *itertools.accumulate(range(len(y)), lambda best, j, row=row, p=p: max(best, row[j + 1], row[j] + (p == y[j])), initial=0)][1:]
        return row[-1]

    def plain(x, y):
        s, t = set(x.split()), set(y.split())
        if not s or not t or (s & t and (s <= t or t <= s)):
            return 100.0 if s and t else 0.0
        base = " ".join(sorted(s & t))
        left, right = (f"{base} {' '.join(sorted(d))}".strip() for d in (s - t, t - s))
        return max(200.0 * common(p, q) / (len(p) + len(q)) for p, q in [(left, right)] + ([(base, left), (base, right)] if base else []))

    names = crowd(3)[:40] + ["", "a", "é ü", "aba", "abab ab"]
    a, b = zip(*itertools.product(names, names), strict=True)
    assert list(token_set_ratio.func(pd.Series(a), pd.Series(b))) == list(map(plain, a, b))
