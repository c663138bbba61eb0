"""JSON repair against a plain version, and what it recovers."""

import json
import random
import re

from pyspark.sql import functions as F
from quarryline.functions import answers


def strict(s):
    def no(_):
        raise ValueError

    try:
        return json.loads(s, parse_constant=no)
    except ValueError:
        return None


def plain(text):
    """Braces balanced, as documented."""
    s = (text or "").strip()
    m = re.search(r"```(?:json)?\s*(.+?)```", s, re.DOTALL)
    s = m[1].strip() if m else s
    if "{" not in s:
        return None
    s = s[s.index("{") :]
    depth, quoted, escaped = 0, False, False
    for i, c in enumerate(s):
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return strict(s[: i + 1])
    return strict(s.rstrip().rstrip(",") + "}" * depth)


def test_against_a_plain_version(spark):
    rng = random.Random(1)
    values = ["x", 'say "hi"', "a\\b", "{not} [a] key", "", "é😀\n", 3, -2.5, None, True, [1, [2, {"z": "]"}]], {"k": {"m": "}"}}, "```"]
    texts = [None, "", " ", "no object", "{", "}", "{}", "{} x", "[1, 2]", '{"a":1,"a":2}', '{"a":NaN}', "{'a':1}", '{"a":1}}', '{"a":[1,2}', '"{"a":1}', "{{", '{"a" 1}', "``` ```", '```json\n{"a": 1}\n``` more {"b": 2}', '{"a": 1, ', '{"a": {"b": 1', '{"a": "open', '{"a": "x\\']
    for _ in range(250):
        s = json.dumps({f"k{i}": rng.choice(values) for i in range(rng.randrange(4))}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        texts += [s, f"Sure:\n```json\n{s}\n```\ndone", s[: rng.randrange(len(s) + 1)], f"so {s} and {{more}}", "".join(c for c in s if rng.random() > 0.03)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", answers.repaired_json(F.col("text")).alias("shallow"), answers.repaired_json(F.col("text"), deep=True).alias("deep"))
    for r in df.collect():
        want = plain(texts[r["k"]])
        assert (None if r["shallow"] is None else json.loads(r["shallow"])) == (want if isinstance(want, dict) else None), texts[r["k"]]
        assert r["deep"] is None or isinstance(strict(r["deep"]), dict)
        if want is not None and isinstance(strict(texts[r["k"]]), dict):
            assert json.loads(r["deep"]) == want


def test_deep_repair_closes_strings_and_lists(spark):
    cases = {'{"a": [1, 2': {"a": [1, 2]}, '{"a": "op': {"a": "op"}, '{"a": [{"b": "x\\': {"a": [{"b": "x"}]}, '{"a":': {"a": None}, '{"a": 1, "b"': {"a": 1, "b": None}, '{"a": [1, ': {"a": [1]}, '{"a": 1]}': None}
    rows = spark.createDataFrame([(t,) for t in cases], "text string").select("text", answers.repaired_json(F.col("text"), deep=True).alias("got")).collect()
    assert {r["text"]: r["got"] and json.loads(r["got"]) for r in rows} == cases
    r = spark.createDataFrame([('x {"a": 1, "b": "y", "c": [2',)], "text string").select(answers.answer_fields(F.col("text"), "a int, b string, c array<int>", deep=True).alias("f")).first()["f"]
    assert (r["a"], r["b"], r["c"]) == (1, "y", [2])
