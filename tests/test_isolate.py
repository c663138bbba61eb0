"""A failing row keeps its failure to itself."""

from quarryline.operators.isolate import isolated


def test_rows_fail_alone(spark):
    calls = []

    def run(frame):
        calls.append(len(frame))
        return frame.assign(half=[100 // x for x in frame["x"]], said=[str(t).upper() for t in frame["t"]])

    rows = [(i, i % 7, None if i % 5 == 0 else f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x int, t string").coalesce(2)
    got = {r["k"]: r for r in isolated(df, run, "half int, said string").collect()}
    assert len(got) == 200
    for k, x, t in rows:
        r = got[k]
        if x == 0:
            assert r["half"] is None and r["said"] is None and r["error"]["kind"] == "ZeroDivisionError" and "zero" in r["error"]["message"]
        else:
            assert (r["half"], r["said"], r["error"]) == (100 // x, str(t).upper(), None)
    assert isolated(df.where("false"), run, "half int, said string").isEmpty()
    wrong = isolated(df.where("k < 3"), lambda f: f.iloc[:0].assign(half=[], said=[]), "half int, said string").collect()
    assert all(r["error"]["kind"] == "ValueError" for r in wrong) and len(wrong) == 3
