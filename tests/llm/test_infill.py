"""Fill-in-the-middle against a plain version, on awkward texts."""

import hashlib
import re

from pyspark.sql import functions as F
from quarryline.llm import infill

TEXTS = ["", None, "\n", "\n\n\n", "one", "one\n", "a\nb\nc\nd", "x\x1fy\n\x1e0\x1e1\x1f\nz\x1e", "has <P> in\nit", "<S", "<\n<\n<P\n>", "é😀\n日本\r\nend", "q " * 50_000 + "\n" + "r\n" * 30_000, "$1 \\ $0\n\\n", "a\x00b\nc"]


def made(text, doc_id, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_against_a_plain_version(spark):
    rows = [(i * 100 + k, t, "x", "y") for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc", "x", "y"), (5, "a\nb", "x", "y"), (5, "a\nb", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, form string")
    for rate, spm in ((100, 50), (40, 0), (70, 100)):
        got = infill.fill_in_middle(df, rate=rate, spm=spm)
        got = got.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        key = lambda r: str(r)
        wanted = [(d, *made(t or "", d, rate, spm), t or "") for d, t, *_ in rows]
        assert sorted([tuple(r) for r in got], key=key) == sorted(wanted, key=key)
    assert {r["form"] for r in got} == {"plain", "spm"}
    assert infill.fill_in_middle(df.where("false")).isEmpty()


def test_other_units_and_columns(spark):
    df = spark.createDataFrame([(3, "one two  three", "kept")], "doc_id long, text string, lang string")
    r = infill.fill_in_middle(df, unit=r"\S+\s*", others=("lang",)).first()
    assert r["n"] == 3 and r["lang"] == "kept"
