"""Salvage of JSON objects from free-text responses, as a batch expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.scoring import ACTIONS, recommended_action

BLANKS = " \n\r\t"


def strip_fences(text: Column) -> Column:
    """The text inside a leading and a trailing code fence, with or without the language's name."""
    body = F.substring(text, F.lit(4), F.char_length(text))
    named = F.substring(text, F.lit(8), F.char_length(text))
    inner = F.when(text.startswith("```json"), named).when(text.startswith("```"), body).otherwise(text)
    ended = F.rtrim(inner, F.lit(BLANKS))
    shorter = F.substring(ended, F.lit(1), F.char_length(ended) - 3)
    return F.trim(F.when(ended.endswith("```"), shorter).otherwise(ended), F.lit(BLANKS))


def embedded_object(text: Column) -> Column:
    """The first balanced object in the text, or an empty string; braces in quotes do not count.

    One pass over the characters from the first brace on, however deep the nesting.
    """
    start = F.instr(text, "{")
    rest = F.when(start > 0, F.substring(text, start, F.char_length(text))).otherwise("")
    zero = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"),
        F.lit(0).alias("n"), F.lit(False).alias("closed"),
    )

    def step(s: Column, c: Column) -> Column:
        opens, closes = ~s["quoted"] & (c == "{"), ~s["quoted"] & (c == "}")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        read = F.struct(
            depth.alias("depth"),
            F.when((c == '"') & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"),
            (s["n"] + 1).alias("n"),
            (closes & (depth == 0)).alias("closed"),
        )
        return F.when(s["closed"], s).otherwise(read)

    def found(s: Column) -> Column:
        return F.when(s["closed"], F.substring(rest, F.lit(1), s["n"])).otherwise("")

    return F.aggregate(F.split(rest, ""), zero, step, found)


def parse_object(text: Column) -> Column:
    """Direct parse, then without code fences, then the first embedded object; else null."""

    def as_object(c: Column) -> Column:
        # a one-element array, so that the text is parsed once for both the test and the value
        found = F.filter(
            F.array(F.try_parse_json(c)), lambda v: F.schema_of_variant(v).startswith("OBJECT")
        )
        return F.get(found, F.lit(0))

    return F.coalesce(
        as_object(text), as_object(strip_fences(text)), as_object(embedded_object(text))
    )


def salvage(df: DataFrame, text: str, raw_score: str) -> DataFrame:
    """Add is_json, narrative, evidence and action; an action outside the three follows the score."""
    parsed = df.withColumn("_parsed", parse_object(F.col(text)))
    field = lambda path, kind: F.try_variant_get("_parsed", path, kind)
    action = field("$.recommended_action", "string")
    return parsed.withColumns(
        {
            "is_json": F.col("_parsed").isNotNull(),
            "threat_narrative": F.coalesce(field("$.threat_narrative", "string"), F.lit("")),
            "evidence_list": F.coalesce(
                field("$.evidence_list", "array<string>"), F.array().cast("array<string>")
            ),
            "recommended_action": F.when(action.isin(ACTIONS), action).otherwise(
                recommended_action(F.col(raw_score))
            ),
        }
    ).drop("_parsed")
