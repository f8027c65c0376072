"""Commands that PowerShell's module log and pipeline records name, written back as they may have been typed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a payload's lines begin, and what the host adds to every pipeline.
INVOCATION = r'^CommandInvocation\(([^)]*)\): "'
BINDING = r'^ParameterBinding\(([^)]*)\): name="([^"]*)"; value="(.*)$'
ERROR = r"^(?:Non)?TerminatingError\("
OF_THE_HOST = ("out-default", "psconsolehostreadline")


def _word(name: Column, value: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when((name != "") & (value == "True"), F.concat(F.lit("-"), name)).when(name != "", F.concat(F.lit("-"), name, F.lit(" "), quoted)).otherwise(quoted)


def pipeline(payload: Column) -> Column:
    """The commands of a payload with their parameters, joined by bars; null if it names none.

    A fold over the payload's lines: an invocation begins a command, a binding a parameter, whose value goes on over
    lines until one ends in a quote; errors end a value, other lines say nothing.
    """
    lines = F.transform(F.split(payload, "\n"), lambda raw: F.regexp_replace(raw, r"\r+$", ""))
    read = F.transform(
        lines,
        lambda x: F.struct(
            x.alias("line"),
            F.when(x.rlike(INVOCATION), F.regexp_extract(x, INVOCATION, 1)).alias("command"),
            F.when(x.rlike(BINDING), F.regexp_extract(x, BINDING, 2)).alias("name"),
            F.regexp_extract(x, BINDING, 3).alias("value"),
            x.rlike(ERROR).alias("error"),
        ),
    )
    none, words = F.lit(None).cast("string"), F.array().cast("array<string>")

    def state(done: Column, command: Column, said: Column, name: Column, value: Column, goes_on: Column) -> Column:
        return F.struct(done.alias("done"), command.alias("command"), said.alias("said"), name.alias("name"), value.alias("value"), goes_on.alias("goes_on"))

    def said(s: Column) -> Column:
        return F.when(s["name"].isNotNull(), F.array_append(s["said"], _word(s["name"], s["value"]))).otherwise(s["said"])

    def done(s: Column) -> Column:
        counts = s["command"].isNotNull() & ~F.lower(s["command"]).isin(*OF_THE_HOST)
        return F.when(counts, F.array_append(s["done"], F.array_join(F.concat(F.array(s["command"]), said(s)), " "))).otherwise(s["done"])

    def ended(text: Column) -> Column:
        return F.when(text.endswith('"'), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)

    def step(s: Column, x: Column) -> Column:
        more = F.concat(s["value"], F.lit("\n"), ended(x["line"]))
        return (
            F.when(x["command"].isNotNull(), state(done(s), x["command"], words, none, none, F.lit(False)))
            .when(x["name"].isNotNull() & s["command"].isNotNull(), state(s["done"], s["command"], said(s), x["name"], ended(x["value"]), ~x["value"].endswith('"')))
            .when(x["error"], state(s["done"], s["command"], s["said"], s["name"], s["value"], F.lit(False)))
            .when(s["goes_on"] & s["name"].isNotNull(), state(s["done"], s["command"], s["said"], s["name"], more, ~x["line"].endswith('"')))
            .otherwise(s)
        )

    return F.nullif(F.aggregate(read, state(words, none, words, none, none, F.lit(False)), step, lambda s: F.array_join(done(s), " | ")), F.lit(""))
