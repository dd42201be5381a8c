"""Candidate detection (J-01) and detected-record assembly (J-02, A-11).

Every occurrence of a value is a candidate of its own, with its position and the text round
it. Per rule, the matches (``regexp_extract_all``) and the stretches between them (``split``
by the same pattern) are zipped; running sums of their lengths give offsets. A match next to
a letter or digit (numbers: also next to a dot or dash with a digit behind it) is part of a longer
token and no candidate. Of overlapping matches of several rules the earlier rule wins: a sweep
over the matches in text order cuts them into clusters of overlapping ones, and only within a
cluster matches are compared.

No pattern matches across a line feed, so a text may be cut after any of them: ``segments`` cuts
long texts into runs of whole lines with the neighbouring characters that contexts need, and every
match is owned by the segment whose lines hold it. The candidates are the same for every segment
size. All of it is a map-only job on the JVM; neither texts nor candidates cross a shuffle.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalogue as cat
from .rows import generator_input, sealed

CONTEXT_CHARS = 120  # context on each side unless asked for otherwise
#: characters of a segment, about; a longer line is a segment of its own
SEGMENT_CHARS = 1 << 16
_BLOCK = 64
_HIT = "array<struct<start:int,end:int,rule:int,value:string>>"


def _valid(etype: str, value: Column) -> Column:
    """Post-extraction validity checks that the regex alone cannot express."""
    if etype == "IPV4":
        octets = [F.split_part(value, F.lit("."), F.lit(i)).cast("int") for i in range(1, 5)]
        return (F.length(value) > 0) & (F.greatest(*octets) <= 255)
    return F.length(value) > 0


def _inline(name: str, expr: Column) -> Column:
    return expr


def _before(values: Column, zero: Column, op, ref, name: str):
    """Function i -> ``op`` over the values before place i, in O(n) for all places.

    Totals before every block of 64 values are folded once (``ref`` keeps them as a column);
    within a block at most 63 values are folded again.
    """
    def fold(part: Column) -> Column:
        return F.aggregate(part, zero, op)

    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
    totals = ref(name, F.when(F.size(values) > 0, F.aggregate(
        blocks, F.array(zero), lambda acc, b: F.concat(
            acc, F.array(op(F.element_at(acc, -1), fold(F.slice(values, b * _BLOCK + 1, _BLOCK))))))))

    def at(i: Column) -> Column:
        first = F.floor(i / _BLOCK).cast("int")
        return op(F.get(totals, first), fold(F.slice(values, first * _BLOCK + 1, i % _BLOCK)))
    return at


def _rule_hits(k: int, rule, text: Column, gate: Column | None, ref) -> Column:
    """Matches of one rule as ``array<struct<start,end,rule,value>>``, start counted from 0."""
    etype, _, pattern, group = rule
    none = F.array().cast("array<string>")

    def all_of(g: int) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
        return hits if gate is None else F.when(gate, hits).otherwise(none)
    whole = ref(f"_h{k}", all_of(0))
    some = F.size(whole) > 0
    value = whole if group == 0 else ref(f"_v{k}", F.when(some, all_of(group)).otherwise(none))
    gaps = ref(f"_g{k}", F.when(some, F.split(text, pattern, -1)).otherwise(none))
    steps = ref(f"_n{k}", F.transform(whole, lambda x, i: F.length(x) + F.length(F.get(gaps, i))))
    before = _before(steps, F.lit(0), lambda x, y: x + y, ref, f"_b{k}")
    left, right = cat.DETECTION_EDGES.get(etype, (None, None))

    def hit(x: Column, i: Column) -> Column:
        start = before(i) + F.length(F.get(gaps, i))
        own = F.get(value, i)
        if group:         # the value ends a fixed number of characters before the match does
            start = start + F.length(x) - cat.DETECTION_TAILS[etype] - F.length(own)
        ok = _valid(etype, own)
        if left:
            ok = ok & ~F.right(F.concat(F.coalesce(F.get(whole, i - 1), F.lit("")), F.get(gaps, i)), F.lit(2)).rlike(left)
            ok = ok & ~F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(whole, i + 1), F.lit(""))), F.lit(2)).rlike(right)
        return F.when(ok, F.struct(start.alias("start"), (start + F.length(own)).alias("end"),
                                   F.lit(k).alias("rule"), own.alias("value")))
    return F.filter(F.transform(whole, hit), lambda h: h.isNotNull())


def _resolved(hits: Column, ref) -> Column:
    """Of overlapping hits those of the earliest rules; ``hits`` are sorted by start."""
    ends = ref("_e0", F.transform(hits, lambda h: h.end))
    reach = _before(ends, F.lit(0), lambda x, y: F.greatest(x, y), ref, "_r0")
    n = F.size(hits)
    heads = ref("_c0", F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(hits, i).start >= reach(i)))

    def cluster(first: Column, j: Column) -> Column:
        own = F.slice(hits, first + 1, F.coalesce(F.get(heads, j + 1), n) - first)
        by_rule = F.array_sort(F.transform(own, lambda h: F.struct(
            h.rule.alias("rule"), h.start.alias("start"), h.end.alias("end"), h.value.alias("value"))))
        return F.when(F.size(own) == 1, own).otherwise(F.aggregate(
            by_rule, F.array().cast(_HIT), lambda kept, h: F.when(
                F.exists(kept, lambda o: (o.start < h.end) & (h.start < o.end)), kept).otherwise(F.concat(kept, F.array(
                    F.struct(h.start.alias("start"), h.end.alias("end"), h.rule.alias("rule"), h.value.alias("value")))))))
    return F.when(n < 2, hits).when(F.size(heads) == n, hits).otherwise(
        F.array_sort(F.flatten(F.transform(heads, cluster))))


def candidate_array(text: Column, rules=None, context_chars: int = CONTEXT_CHARS, ref=_inline,
                    left: Column | None = None, right: Column | None = None, base: Column | None = None) -> Column:
    """All candidates of one text in text order as an array, computed in the row.

    ``left`` and ``right`` are the characters round the text and ``base`` the number of characters
    before it, where it is a segment of a longer one. Pass ``ref`` (see ``detect_arrays``) to keep
    intermediate arrays as columns: expressions inside a lambda are evaluated again for every element."""
    rules = rules or cat.DETECTION_RULES
    lowered = ref("_lowered", F.lower(text))
    gate_names = {g: f"_gate{chr(97 + i)}" for i, g in enumerate(sorted(set(cat.DETECTION_GATES.values())))}
    gates = {g: ref(n, text.rlike(g)) for g, n in gate_names.items()}
    per_rule = []
    for k, rule in enumerate(rules):
        gate = gates[cat.DETECTION_GATES[rule[0]]] if rule[0] in cat.DETECTION_GATES else None
        if rule[0] in cat.DETECTION_NEEDLES:
            needles, lower = cat.DETECTION_NEEDLES[rule[0]]
            present = None
            for nd in needles:
                c = F.instr(lowered if lower else text, nd) > 0
                present = c if present is None else present | c
            gate = present if gate is None else gate & present
        per_rule.append(_rule_hits(k, rule, text, gate, ref))
    hits = ref("_z0", F.array_sort(F.concat(*per_rule)))
    kept = ref("_k0", _resolved(hits, ref))
    around = text
    skip = F.lit(0)
    if left is not None:
        around = ref("_t0", F.when(F.size(kept) > 0, F.concat(left, text, right)))
        skip = F.length(left)
    kinds = F.array(*[F.lit(r[0]) for r in rules])
    labels = F.array(*[F.lit(r[1]) for r in rules])

    def candidate(h: Column) -> Column:
        at = h.start + skip
        start = F.greatest(at - context_chars, F.lit(0))
        return F.struct(F.get(kinds, h.rule).alias("entity_type"), F.get(labels, h.rule).alias("label"),
                        h.value.alias("entity_value"),
                        (h.start + 1 + (F.lit(0) if base is None else base)).cast("bigint").alias("pos"),
                        F.substring(around, start + 1, at - start + F.length(h.value) + context_chars).alias("context"),
                        (at - start).cast("int").alias("ctx_offset"))
    return F.coalesce(F.transform(kept, candidate), F.array().cast(f"array<{CANDIDATE}>"))


CANDIDATE = "struct<entity_type:string,label:string,entity_value:string,pos:bigint,context:string,ctx_offset:int>"


def segments(df: DataFrame, text_col: str = "text", size: int = SEGMENT_CHARS,
             context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """Cut ``text_col`` into runs of whole lines of up to ``size`` characters, one row each.

    Adds ``_left`` and ``_right``, up to ``context_chars`` characters round the segment, and ``_base``,
    the number of characters before it. A line longer than ``size`` is a segment of its own. Two
    neighbouring segments are together longer than ``size``, so two of them always hold the context.
    """
    if size < 2 * context_chars:
        raise ValueError(f"segments of {size} characters are too short for contexts of {context_chars}")
    text = F.col(text_col)
    cut = rf"(?s)(.{{1,{size}}}(?:\n|\z)|[^\n]*\n|[^\n]+\z)"
    parts = F.when(F.length(text) <= size, F.array(text)).otherwise(
        F.filter(F.regexp_extract_all(text, F.lit(cut), F.lit(1)), lambda x: F.length(x) > 0))
    held: dict[str, Column] = {}

    def ref(name: str, expr: Column) -> Column:
        held[name] = expr
        return F.col(name)
    before = _before(F.col("_sizes"), F.lit(0).cast("bigint"), lambda x, y: x + y, ref, "_sums")
    part = lambda i: F.coalesce(F.get(F.col("_parts"), i), F.lit(""))
    rest = [c for c in df.columns if c != text_col]
    out = df.withColumn("_parts", parts).withColumn(
        "_sizes", F.transform("_parts", lambda x: F.length(x).cast("bigint")))
    out = out.withColumns(held).withColumn("_rows", F.transform("_parts", lambda x, i: F.struct(
        x.alias(text_col), F.right(F.concat(part(i - 2), part(i - 1)), F.lit(context_chars)).alias("_left"),
        F.left(F.concat(part(i + 1), part(i + 2)), F.lit(context_chars)).alias("_right"), before(i).alias("_base"))))
    return out.select(*rest, F.inline(generator_input("_rows")))


def labels_of(candidates: Column) -> Column:
    """J-02: sorted distinct labels of a candidate array."""
    return F.array_sort(F.array_distinct(F.transform(candidates, lambda c: c.label)))


def detect_arrays(df: DataFrame, text_col: str = "text", rules=None,
                  context_chars: int = CONTEXT_CHARS, labels_out: str = "PIIs") -> DataFrame:
    """Add ``candidates`` (array) and ``PIIs`` (sorted distinct labels) to every row.

    Everything a later per-document step needs stays in the document's row, so verifying,
    labelling and building per-model results need no join back to the documents.
    """
    levels, cands, labels = _detection_plan(text_col, _rules_key(rules), context_chars, False)
    for group in levels:
        df = df.withColumns(dict(group))
    df = df.withColumn("candidates", cands).drop(*[n for group in levels for n, _ in group])
    return sealed(df.withColumn(labels_out, labels))


def _rules_key(rules):
    return None if rules is None else tuple(tuple(r) for r in rules)


@lru_cache(maxsize=32)
def _detection_plan(text_col: str, rules_key, context_chars: int, segmented: bool):
    """Built once per parameter set: the Column trees are large (thousands of py4j calls)
    and immutable, so every query reuses them."""
    stages: list[tuple[str, Column]] = []

    def ref(name, expr):
        stages.append((name, expr))
        return F.col(name)

    around = (F.col("_left"), F.col("_right"), F.col("_base")) if segmented else (None, None, None)
    cands = candidate_array(F.col(text_col), list(rules_key) if rules_key else None, context_chars, ref, *around)
    # one projection per dependency level (_lowered, _gate*, _h*, _v*, ...), not one per column
    levels: dict[str, list[tuple[str, Column]]] = {}
    for name, expr in stages:
        levels.setdefault(name.rstrip("0123456789"), []).append((name, expr))
    return tuple(tuple(g) for g in levels.values()), cands, labels_of(F.col("candidates"))


def detect_candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None,
                      context_chars: int = CONTEXT_CHARS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Find PII candidates in ``text_col``.

    Output: ``id_col, entity_type, label, entity_value, pos, context, ctx_offset``, one row per
    occurrence; ``pos`` is its 1-based position in the text, ``context`` holds ``context_chars``
    characters on each side of it and ``ctx_offset`` the 0-based offset of the value inside it.
    Long texts are worked in segments of about ``segment_chars`` characters; the size changes no
    result. The whole job is map-only: no shuffle, no aggregate.
    """
    rows = segments(df.select(id_col, text_col), text_col, segment_chars, context_chars)
    levels, cands, _ = _detection_plan(text_col, _rules_key(rules), context_chars, True)
    for group in levels:
        rows = rows.withColumns(dict(group))
    return rows.select(F.col(id_col), cands.alias("candidates")).select(
        F.col(id_col), F.inline(generator_input("candidates")))


def detected_records(records: DataFrame, candidates: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """J-02: ``DetectedRecord`` = (recordId, input, PIIs) with sorted distinct labels.

    Records without candidates keep an empty ``PIIs`` (left join of the small per-record
    label list onto the records, co-partitioned on the id).
    """
    labels = candidates.groupBy(id_col).agg(
        F.array_sort(F.collect_set("label")).alias("PIIs"))
    return (records.select(id_col, text_col)
            .join(labels, id_col, "left")
            .select(F.col(id_col).cast("string").alias("recordId"),
                    F.col(text_col).alias("input"),
                    F.coalesce("PIIs", F.array().cast("array<string>")).alias("PIIs")))
