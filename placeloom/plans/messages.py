"""The text that asks for one query: a line for each field that the request's kind names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.operators.validate import NEEDS_COUNTRY, NEEDS_REGION


def user_message(source: Column, language: Column, name: Column, region: Column, country: Column, style: Column, topic: Column) -> Column:
    """Null fields are empty, fields that the kind doesn't name are left out; an unknown kind gives null rather than some other kind's text."""

    def line(field: str, value: Column) -> Column:
        return F.concat(F.lit(f"{field}: "), F.coalesce(value, F.lit("")))

    known = source.isin("one_city", "multi_city", *NEEDS_REGION, *NEEDS_COUNTRY)
    title = F.when(source == "multi_city", line("names", name)).otherwise(line("name", name))
    text = F.concat_ws("\n", line("language", language), title, F.when(source.isin(NEEDS_REGION), line("region", region)), F.when(source.isin(NEEDS_COUNTRY), line("country", country)), line("style", style), line("topic", topic))
    return F.when(known, text)


#: What a query must and must not hold, in our own words; one line for each promise that ``validate`` checks.
_COMMON = [
    "Write one search query as a person would type it, in the given language.",
    "Answer with one JSON object: query (text), entities (list of text and label), confidence (0 to 1).",
    "Each entity text must occur in the query letter for letter, inflected as it stands there.",
    "Name no place that was not asked for, and write more than the bare name.",
]
_CITY = {False: "Exactly one entity has the label CITY.", True: "Every given name is one entity with the label CITY."}
_REGION = {False: "No entity has the label REGION or STATE.", True: "Exactly one entity has the label REGION or STATE: the given region."}
_COUNTRY = {False: "No entity has the label COUNTRY.", True: "Exactly one entity has the label COUNTRY: the given country."}


def system_message(source: Column) -> Column:
    """The standing instruction for a kind of request, made of the same flags that its answers are checked by; null for an unknown kind."""
    out = F.lit(None).cast("string")
    for kind in ("one_city", "multi_city", *dict.fromkeys([*NEEDS_REGION, *NEEDS_COUNTRY])):
        text = "\n".join([*_COMMON, _CITY[kind == "multi_city"], _REGION[kind in NEEDS_REGION], _COUNTRY[kind in NEEDS_COUNTRY]])
        out = F.when(source == kind, F.lit(text)).otherwise(out)
    return out
