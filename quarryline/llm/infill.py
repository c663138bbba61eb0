"""Fill-in-the-middle texts by escaped marker injection.

A delimiter and its escape are spelt out where a text has them, ``regexp_replace`` then
sets the delimiter after every unit, counting it gives the number of units, and
``substring_index`` takes the parts by rank: the prefix ends after the smaller of two
hashed ranks, the middle after the larger.  The parts lose the delimiters, are unescaped
and put together in one of the two orders.  Column functions alone, no shuffle.

Defined results: a null text is empty; an empty text and one that contains a marker stay
plain; prefix, middle and suffix may be empty (equal ranks, or rank 0 or n); a null doc_id
is hashed as no digits; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT, ESCAPE = "\x1f", "\x1e"
SEED = 7


def escaped(text: Column) -> Column:
    """The text without a delimiter: the escape becomes escape-0, the delimiter escape-1."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(CUT), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(CUT)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def injected(text: Column, unit: str = LINES) -> Column:
    """The escaped text with the delimiter after every unit."""
    return F.regexp_replace(escaped(text), F.lit(f"(?:{unit})"), F.lit("$0" + CUT))


def _plain(part: Column) -> Column:
    return unescaped(F.replace(part, F.lit(CUT), F.lit("")))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from.  No part has a marker and no marker can begin inside
    another, so each marker's first place is its own."""
    past = lambda c, mark: F.substring(c, F.instr(c, mark) + len(mark), F.length(c))
    before = lambda c, mark: F.substring_index(c, mark, 1)
    psm = past(output, PREFIX)
    after = past(psm, SUFFIX)
    spm = past(output, SUFFIX)
    rest = past(spm, PREFIX)
    return (
        F.when(form == "psm", F.concat(before(psm, SUFFIX), past(after, MIDDLE), before(after, MIDDLE)))
        .when(form == "spm", F.concat(before(rest, MIDDLE), past(rest, MIDDLE), before(spm, PREFIX)))
        .otherwise(output)
    )


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = 100, spm: int = 50, unit: str = LINES, others: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row and ``others``.

    ``rate`` of a hundred texts are rearranged, ``spm`` of a hundred of these with the
    suffix first; ``unit`` is the pattern of the units.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("_hash", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", *others, text.alias("_text"), hashed.alias("_hash"))
    rows = rows.withColumn("_cut", injected(F.col("_text"), unit)).withColumn("n", F.regexp_count("_cut", F.lit(CUT)).cast("long"))
    kept = reduce(lambda a, m: a | F.contains("_text", F.lit(m)), (PREFIX, SUFFIX, MIDDLE), (F.col("_text") == "") | (h[2] % 100 >= rate))
    form = F.when(kept, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    ranks = [h[i] % (F.col("n") + 1) for i in range(2)]
    rows = rows.withColumn("form", form).withColumn("_a", F.least(*ranks).cast("int")).withColumn("_b", F.greatest(*ranks).cast("int"))
    rows = rows.withColumn("_upto", F.expr(f"substring_index(_cut, '{CUT}', _b)"))  # ranks are columns, which only the SQL form takes
    rows = rows.select(
        "doc_id",
        *others,
        "n",
        "form",
        "_text",
        _plain(F.expr(f"substring_index(_upto, '{CUT}', _a)")).alias("_prefix"),
        _plain(F.expr(f"substring_index(_upto, '{CUT}', _a - _b)")).alias("_middle"),
        _plain(F.expr(f"substring_index(_cut, '{CUT}', cast(_b - n - 1 AS int))")).alias("_suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "_prefix", F.lit(SUFFIX), "_suffix", F.lit(MIDDLE), "_middle")
    spm_ = F.concat(F.lit(SUFFIX), "_suffix", F.lit(PREFIX), "_prefix", F.lit(MIDDLE), "_middle")
    moved = F.col("form") != "plain"
    return rows.select(
        "doc_id",
        *others,
        "n",
        "form",
        F.when(moved, F.length("_prefix").cast("long")).alias("prefix_chars"),
        F.when(moved, F.length("_middle").cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("_text")).alias("output"),
    )


def op12_fill_in_middle(spark, sf_dir):
    """Every whole text of ``documents``, cut into lines."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


INFILL_SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS parts, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST(len(parts) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
c AS (SELECT *, coalesce(array_to_string(list_slice(parts, 1, a), ''), '') AS p, coalesce(array_to_string(list_slice(parts, a + 1, b), ''), '') AS m, coalesce(array_to_string(list_slice(parts, b + 1, n), ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM c
"""
