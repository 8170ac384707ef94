"""What an audit finding says: a catalogue of typed messages, rendered in the row after one count per rule.

Templates hold ``{n}`` for the number of rows, ``{e}`` for the number of distinct entities, and ``{n|one|many}`` or ``{e|one|many}`` for words that follow a number.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Message(NamedTuple):
    title: str
    summary: str
    rationale: str = ""
    #: Document where the rows stand in full.
    see: str = ""


MESSAGES = {
    "A1": Message("Automatic date tables", "{n} hidden date {n|table was|tables were} generated.", "Each date column gets a table of its own; one date table for all keeps the model small.", "DataDictionary"),
    "A2": Message("Measures that depend on themselves", "{n} {n|measure lies|measures lie} on a cycle.", "A measure on a cycle cannot be evaluated.", "Measures"),
    "A3": Message("{n} broken {n|reference|references}", "{e} {e|expression names|expressions name} what the model doesn't have.", "Such an expression fails once it is evaluated; renamed fields are the usual cause.", "Measures"),
    "A4": Message("Calculated tables read directly", "{n} calculated {n|table has|tables have} a direct partition.", "What is calculated at refresh should be stored, or be read as an entity.", "Sources"),
    "A5": Message("{n} unused {n|measure|measures}", "No visual and no other measure needs {n|it|them}.", "Fewer measures are easier to find and to keep right.", "Measures"),
    "A6": Message("{n} {n|measure|measures} needed by unused ones only", "Other measures use {n|it|them}, but no visual shows any of those.", "Once the unused measures on top go, these are unused as well.", "Measures"),
    "A7": Message("{n} unused {n|column|columns}", "No visual, relationship or used measure needs {n|it|them}; keys are left out.", "Columns nobody reads still take memory.", "DataDictionary"),
    "A8": Message("{n} inactive {n|relationship|relationships} nobody switches on", "No measure activates {n|it|them}.", "Without a caller an inactive relationship does nothing.", "Model"),
    "A9": Message("Tables without a description", "{n} {n|table lacks|tables lack} one.", "Descriptions are what users see when they choose a field.", "Model"),
    "A10": Message("Measures without a description", "{n} {n|measure lacks|measures lack} one.", "A measure's name rarely tells how it is meant.", "Measures"),
    "A11": Message("{n} long {n|expression|expressions}", "{n|It has|They have} 30 or more lines.", "Parts of a long expression can be measures or variables.", "Measures"),
    "A12": Message("Measures with equal bodies", "{n} {n|measure repeats|measures repeat} another one's text.", "One of them can call the other.", "Measures"),
    "A13": Message("{n} empty {n|page|pages}", "Visible, but without a visual.", "", "Pages"),
    "A14": Message("Web addresses of another type", "{n} {n|column is|columns are} marked as an address but {n|isn't|aren't} text.", "Reports show an address only if it is text.", "DataDictionary"),
    "A15": Message("Columns without a description", "{n} {n|column lacks|columns lack} one.", "", "DataDictionary"),
    "A16": Message("Model without a description", "It says nothing about its purpose.", "", "Model"),
    "A17": Message("{n} numeric {n|column|columns} without a format", "Every report has to choose one.", "", "DataDictionary"),
    "A18": Message("Measures of remote models", "{n} {n|measure stands|measures stand} for one elsewhere.", "Changes there show up here.", "Measures"),
    "A19": Message("Field parameters", "{n} {n|table lets|tables let} readers choose fields.", "", "DataDictionary"),
    "A20": Message("Tables of remote models", "{n} {n|table stands|tables stand} for one elsewhere.", "Their data are read over the network.", "Sources"),
    "A21": Message("Most measures are shown", "At least 85 % are on a visual.", "", ""),
    "A22": Message("Most columns are used", "At least 75 % are on a visual.", "", ""),
    "A23": Message("No cycles", "Measures depend on each other without a loop.", "", ""),
    "A24": Message("Calculation groups", "{n} {n|group replaces|groups replace} variants of measures.", "", "CalcGroups"),
}
_PART = re.compile(r"\{([ne])(?:\|([^|}]*)\|([^}]*))?\}")


def rendered(template: str, rows: Column, entities: Column) -> Column:
    """The template as a column over the two counts."""
    parts, at = [], 0
    for found in _PART.finditer(template):
        count = rows if found[1] == "n" else entities
        parts.append(F.lit(template[at : found.start()]))
        parts.append(count.cast("string") if found[2] is None else F.when(count == 1, found[2]).otherwise(found[3]))
        at = found.end()
    return F.concat(*parts, F.lit(template[at:]))


def described(findings: DataFrame) -> DataFrame:
    """A row for each model and rule that fired: ``rows``, ``entities``, title, summary, rationale and where to read on."""
    per_entity = findings.groupBy("model_id", "severity", "check_id", "entity").agg(F.count(F.lit(1)).alias("_n"))
    counts = per_entity.groupBy("model_id", "severity", "check_id").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("entities"))

    def chosen(field: str) -> Column:
        shown = [F.when(F.col("check_id") == c, rendered(getattr(m, field), F.col("rows"), F.col("entities"))) for c, m in MESSAGES.items()]
        return F.coalesce(*shown, F.lit("")).alias(field)

    return counts.select("*", *(chosen(f) for f in Message._fields))
