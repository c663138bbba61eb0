"""JSON objects out of noisy answers: fenced, wrapped in prose, unbalanced or cut off.

A fold over the characters keeps the brackets that are open, whether a string is open, and
where the first object ended.  Everything is a column function; what cannot be mended is null.

Braces alone are balanced by default, as a cut inside a string or a list says nothing about
what followed.  With ``deep`` an open string and open lists are closed too, and a key that
lost its value gets null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)```(?:json)?\s*(.+?)```"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_BLANK = r"^\s+|\s+$"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def is_object(c: Column) -> Column:
    """Whether a text starting with a brace reads as a JSON object."""
    return F.from_json(c, "map<string,string>", _STRICT).isNotNull()


def object_part(text: Column) -> Column:
    """From the first brace on, of what is inside a fence if there is one; null without a brace."""
    s = _stripped(F.coalesce(text, F.lit("")))
    inside = F.regexp_extract(s, FENCE, 1)
    s = F.when(inside != "", _stripped(inside)).otherwise(s)
    at = F.instr(s, "{")
    return F.when(at > 0, F.substring(s, at, F.length(s)))


def bracket_state(s: Column, lists: bool = False) -> Column:
    """``at, end, quoted, escaped, open`` after all characters: ``open`` are the closing brackets
    still owed, the innermost first; ``end`` is how long the first whole object is (0: none)."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit("").alias("open"))

    def step(a: Column, c: Column) -> Column:
        going = a["end"] == 0
        quote = (c == '"') & ~a["escaped"]
        bare = going & ~a["quoted"]
        push = F.when(c == "{", "}").when(F.lit(lists) & (c == "["), "]")
        pop = bare & (a["open"] != "") & ((c == "}") | (F.lit(lists) & (c == "]"))) & (F.lit(not lists) | (F.substring(a["open"], 1, 1) == c))
        after = F.when(bare & push.isNotNull(), F.concat(push, a["open"])).when(pop, F.substring(a["open"], 2, 1 << 30)).otherwise(a["open"])
        closed = pop & (F.length(a["open"]) == 1)
        return F.struct(
            (a["at"] + 1).alias("at"),
            F.when(closed, a["at"] + 1).otherwise(a["end"]).alias("end"),
            F.when(going & quote, ~a["quoted"]).otherwise(a["quoted"]).alias("quoted"),
            (going & a["quoted"] & (c == "\\") & ~a["escaped"]).alias("escaped"),
            after.alias("open"),
        )

    return F.aggregate(F.split(s, ""), start, step)


def repaired_json(text: Column, deep: bool = False) -> Column:
    """The first JSON object of an answer, closed if it was cut off, as text; null if none reads."""

    def mended(s: Column) -> Column:
        def made(pair: Column) -> Column:
            s, state = pair["s"], pair["state"]
            whole = F.substring(s, F.lit(1), state["end"])
            cut = F.regexp_replace(s, r"\s+$", "")
            if deep:
                cut = F.when(state["escaped"], F.regexp_replace(cut, r"\\$", "")).otherwise(cut)
                cut = F.when(state["quoted"], F.concat(cut, F.lit('"'))).otherwise(cut)
                cut = F.regexp_replace(cut, r"[,\s]+$", "")
                cut = F.when(F.endswith(cut, F.lit(":")), F.concat(cut, F.lit("null"))).otherwise(cut)
                keyed = F.concat(cut, F.lit(":null"), state["open"])  # a key that lost even its colon
                closed = F.concat(cut, state["open"])
                closed = F.when(is_object(closed), closed).otherwise(keyed)
            else:
                closed = F.concat(F.regexp_replace(cut, ",+$", ""), state["open"])
            best = F.when(state["end"] > 0, whole).when(state["open"] != "", closed)
            return F.when(is_object(best), best)

        one = F.array(F.struct(s.alias("s"), bracket_state(s, deep).alias("state")))
        return F.get(F.transform(one, made), F.lit(0))  # an element is evaluated once, a column as often as it is named

    return F.get(F.transform(F.array(object_part(text)), mended), F.lit(0))


def answer_fields(text: Column, schema: str, deep: bool = False) -> Column:
    """An answer's object read by ``schema``; a field of another type is null, all else stays."""
    return F.from_json(repaired_json(text, deep), schema)
