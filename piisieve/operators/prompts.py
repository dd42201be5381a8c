"""Prompt tables (D-03, J-05, J-06, J-07, I-15, I-16).

A prompt is a Column: literal template pieces concatenated with the record's own values.
Placeholders are split out of the literal template once, in Python, so text that happens
to contain ``{detected_piis}`` is never substituted twice (and braces in the template are
never interpreted, unlike a format call). Label descriptions come from a literal map, so
describing labels needs no join and no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalogue as cat
from ..functions.text import py_list_repr

_PH = re.compile(r"\{(input_text|detected_piis|element_descriptions|response_rules|"
                 r"output_example|context|entity_type|entity_value)\}")


def render(template: str, values: dict[str, Column]) -> Column:
    """Concatenate literal pieces of ``template`` with the Columns of its placeholders."""
    pieces, pos = [], 0
    for m in _PH.finditer(template):
        if m.group(1) in values:
            pieces.append(F.lit(template[pos:m.start()]))
            pieces.append(values[m.group(1)])
            pos = m.end()
    pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces)


def catalogue_map(rows=None) -> Column:
    """Literal ``map<name, description>`` of the label catalogue (last duplicate wins)."""
    d = {}
    for name, _category, desc in (rows or cat.LABEL_CATALOGUE):
        if name and desc:
            d[name] = desc
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def describe_labels(labels: Column, descriptions: Column | None = None) -> Column:
    """D-03: ``- **name**: description`` per label in list order, joined by newlines.

    Unknown labels get 'No description available.'; an empty list gives 'No PIIs detected.'.
    """
    descriptions = descriptions if descriptions is not None else catalogue_map()
    lines = F.transform(labels, lambda p: F.concat(
        F.lit("- **"), p, F.lit("**: "),
        F.coalesce(F.try_element_at(descriptions, p), F.lit(cat.NO_DESCRIPTION))))
    return F.when(F.size(labels) == 0, F.lit(cat.NO_PIIS)).otherwise(F.array_join(lines, "\n"))


def batch_prompt(text: Column, labels: Column, reasoning: Column,
                 descriptions: Column | None = None, described: Column | None = None) -> Column:
    """J-06: batch verification prompt; ``reasoning`` (boolean Column) picks the output mode.

    ``described`` is the described label list where it is there already (``with_descriptions``)."""
    return render(cat.BATCH_PROMPT, {
        "input_text": text,
        "detected_piis": py_list_repr(labels),
        "element_descriptions": describe_labels(labels, descriptions) if described is None else described,
        "response_rules": F.when(reasoning, F.lit(cat.REASONING_RULES))
                           .otherwise(F.lit(cat.SIMPLE_RULES)),
        "output_example": F.when(reasoning, F.lit(cat.REASONING_EXAMPLE))
                           .otherwise(F.lit(cat.SIMPLE_EXAMPLE)),
    })


def single_prompt(context: Column, entity_type: Column, entity_value: Column) -> Column:
    """J-05: single-entity prompt (deprecated path of the reference, kept for parity)."""
    return render(cat.SINGLE_PROMPT, {"context": context, "entity_type": entity_type,
                                      "entity_value": entity_value})


SYSTEM_MESSAGE = "You are a careful privacy reviewer."
MESSAGE = "struct<role:string,content:string>"


def chat_messages(prompt: Column, family: str) -> Column:
    """J-07: role/content messages per model family.

    ``system_user``: system + user; ``user``: user only; ``raw``: no wrapping (empty array,
    the scorer uses the prompt as is).
    """
    user = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    if family == "system_user":
        sys_msg = F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content"))
        return F.array(sys_msg, user)
    if family == "user":
        return F.array(user)
    if family == "raw":
        return F.array().cast(f"array<{MESSAGE}>")
    raise ValueError(family)


def catalogue_map_from(catalogue: DataFrame, max_rows: int = 100_000) -> Column:
    """A small catalogue table as a literal map; ``with_descriptions`` takes one of any size."""
    rows = catalogue.select("name", "description").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"catalogue has more than {max_rows} rows; use with_descriptions")
    return catalogue_map([(r["name"], "", r["description"]) for r in rows]) if rows else F.create_map().cast("map<string,string>")


def with_descriptions(records: DataFrame, catalogue: DataFrame, labels_col: str = "PIIs",
                      out: str = "element_descriptions", broadcast_rows: int = 100_000) -> DataFrame:
    """D-03 with a catalogue of any size: ``records`` with the described label list as text.

    The distinct label lists, without any text, are exploded, joined with the catalogue (name,
    description; Spark broadcasts what it measures to be small) and put together in list order.
    They go back to the records by a broadcast where they are at most ``broadcast_rows``, by a
    shuffle beyond. A name's last description in sort order counts.
    """
    lists = records.select(F.col(labels_col).alias("_labels")).distinct()
    names = catalogue.where("name <> '' AND description <> ''").groupBy("name").agg(F.max("description").alias("description"))
    parts = lists.select("_labels", F.posexplode("_labels").alias("_at", "_name"))
    line = F.concat(F.lit("- **"), F.col("_name"), F.lit("**: "), F.coalesce("description", F.lit(cat.NO_DESCRIPTION)))
    lines = (parts.join(names, parts["_name"] == names["name"], "left").groupBy("_labels")
             .agg(F.array_sort(F.collect_list(F.struct("_at", line.alias("line")))).alias("_lines"))
             .select("_labels", F.array_join(F.transform("_lines", lambda x: x.line), "\n").alias(out)))
    if lists.limit(broadcast_rows + 1).count() <= broadcast_rows:
        lines = F.broadcast(lines)
    joined = records.join(lines, F.col(labels_col) == F.col("_labels"), "left").drop("_labels")
    return joined.withColumn(out, F.when(F.size(labels_col) == 0, F.lit(cat.NO_PIIS)).otherwise(F.col(out)))


def prompt_table(records: DataFrame, id_col: str = "recordId", text_col: str = "input",
                 labels_col: str = "PIIs", modes=("simple", "reasoning"), catalogue: DataFrame | None = None) -> DataFrame:
    """One prompt per (record, mode); both modes in one job through a ``mode`` column.

    Records without labels get no prompt (they short-circuit, C-03). Labels are described by the
    built-in catalogue, or by the table ``catalogue`` (name, description).
    """
    described = None
    keep = records.select(id_col, text_col, labels_col)
    if catalogue is not None:
        keep = with_descriptions(keep, catalogue, labels_col, "_described")
        described = F.col("_described")
    with_mode = keep.select("*", F.explode(
        F.when(F.size(labels_col) > 0, F.array(*[F.lit(m) for m in modes]))
        .otherwise(F.array().cast("array<string>"))).alias("mode"))
    return with_mode.select(
        id_col, "mode", labels_col,
        batch_prompt(F.col(text_col), F.col(labels_col), F.col("mode") == "reasoning", described=described)
        .alias("prompt"))
