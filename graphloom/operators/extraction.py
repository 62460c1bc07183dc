"""Requirements, notes, constraints and questions out of specification texts, by the structure their authors gave them.

A text's lines run through small automata (headings, fences, nested lists, paragraphs), each a running value over the lines in
their order; items keep the range of the text that they came from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.graph import staged
from graphloom.operators.texts import concepts
from graphloom.plans import wording as T


def _in_order(*by: str, end: int | None = None):
    """A window over the lines of a group in their order; with ``end``, from the first to that one from here."""
    over = W.partitionBy(*by).orderBy("line_no")
    return over if end is None else over.rowsBetween(W.unboundedPreceding, end)


def role_of(heading: Column) -> Column:
    return S.first_of(heading, T.HEADINGS, "unknown")


def lines_of(specs: DataFrame) -> DataFrame:
    """(spec, line_no, line, at) of (spec, text): at is the offset of a line's first code point. A null text has no lines."""
    lines = specs.select("spec", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(_in_order("spec", end=-1)), F.lit(0)))


def _titles(line: Column) -> tuple[Column, Column]:
    """Text and place of a line that stands for a heading: a short phrase in emphasis, or one with a colon that has a role."""
    bare = F.trim(line)
    short = lambda t: (F.length(t) > 0) & (F.size(F.split(t, r"\s+")) <= T.PSEUDO_WORDS) & ~t.rlike(r"[.!?]$")
    strong = bare.rlike(T.EMPHASIS_ONLY)
    inner = F.trim(F.regexp_replace(F.trim(F.regexp_extract(bare, T.EMPHASIS_ONLY, 2)), ":$", ""))
    named = F.trim(F.regexp_replace(bare, ":$", ""))
    open_ = (F.length(bare) > 0) & (F.length(bare) <= T.PSEUDO_CHARS) & ~bare.rlike(T.LIST_MARKER)
    return F.when(open_ & strong & short(inner), inner).when(open_ & ~strong & bare.rlike(T.COLON_HEADING) & short(named) & (role_of(named) != "unknown"), named), F.lit(T.PSEUDO_LEVEL)


def sectioned(lines: DataFrame) -> DataFrame:
    """The lines of bodies with section (0 before the first heading), heading, level and role.

    Headings are marked by #, underlined, or lines that stand for one. A heading without a role of its own has that of the
    nearest heading above it of a lower level.
    """
    after = F.coalesce(F.lead("line").over(_in_order("spec")), F.lit(""))
    atx = F.col("line").rlike(T.ATX)
    under = ~atx & (F.trim("line") != "") & after.rlike(T.UNDERLINE) & ~F.trim("line").rlike(T.LIST_MARKER)
    rows = lines.withColumn("under", under).withColumn("next", after)
    # an underline that could be underlined itself is no heading: of a run of such lines every second one is
    rows = rows.withColumn("last_other", F.max(F.when(~F.col("under"), F.col("line_no"))).over(_in_order("spec", end=0)))
    rows = rows.withColumn("under", F.col("under") & ((F.col("line_no") - F.coalesce("last_other", F.lit(-1))) % 2 == 1))
    rows = rows.withColumn("skip", F.coalesce(F.lag("under").over(_in_order("spec")), F.lit(False)))
    title, depth = _titles(F.col("line"))
    head = F.when(atx, F.regexp_extract("line", T.ATX, 2)).when(F.col("under"), F.trim("line")).when(~F.col("skip"), title)
    level = F.when(atx, F.length(F.regexp_extract("line", T.ATX, 1))).when(F.col("under"), F.when(F.startswith(F.rtrim("next"), F.lit("=")), 1).otherwise(2)).otherwise(depth)
    rows = rows.withColumn("title", head).withColumn("depth", F.when(F.col("title").isNotNull(), level))
    rows = rows.withColumn("role", F.when(F.col("title").isNotNull(), role_of(F.col("title"))))
    for n in range(2, 7):  # headings of a level, after all of lower levels
        above = F.last(F.when(F.col("depth") < n, F.col("role")), ignorenulls=True).over(_in_order("spec", end=-1))
        rows = rows.withColumn("role", F.when((F.col("depth") == n) & (F.col("role") == "unknown"), F.coalesce(above, F.lit("unknown"))).otherwise(F.col("role")))
    held = lambda c: F.last(c, ignorenulls=True).over(_in_order("spec", end=0))
    rows = rows.select("spec", "line_no", "line", "at", "title", "skip", F.count("title").over(_in_order("spec", end=0)).alias("section"), F.coalesce(held("title"), F.lit("")).alias("heading"), F.coalesce(held("depth"), F.lit(0)).alias("level"), F.coalesce(held("role"), F.lit("unknown")).alias("role"))
    return rows.filter(F.col("title").isNull() & ~F.col("skip")).drop("title", "skip")


def started(line: Column, labels: str = T.LABEL) -> list[Column]:
    """What a line starts as a list item, columns origin (null: no item; "plain": by its section), label and rest."""
    bare = F.trim(line)
    inner = F.regexp_replace(bare, T.NUMBERED, "")
    numbered, named = bare.rlike(T.NUMBERED), inner.rlike(labels)
    label = lambda t: F.regexp_replace(F.regexp_extract(t, labels, 1), r"\s+", "-")
    cut = lambda pattern: F.regexp_replace(bare, pattern, "")
    owned, task, bullet = bare.rlike(labels), bare.rlike(T.TASK), bare.rlike(T.BULLET)
    origin = F.when(owned, "explicit-label").when(task, "task-item").when(numbered, F.when(named, "explicit-label").otherwise("numbered-item")).when(bullet, "plain")
    told = F.when(owned, label(bare)).when(task, F.lit(None)).when(numbered, F.when(named, label(inner)).otherwise(F.regexp_extract(bare, T.NUMBERED, 1)))
    rest = F.when(owned, cut(labels)).when(task, cut(T.TASK)).when(numbered, F.when(named, F.regexp_replace(inner, labels, "")).otherwise(inner)).when(bullet, cut(T.BULLET))
    return [origin.alias("origin"), told.alias("label"), rest.alias("rest")]


def scanned(body: DataFrame, labels: str = T.LABEL) -> DataFrame:
    """Body lines with origin, label, rest, fence (a fence's own line) and fenced (between fences of one section)."""
    rows = body.select("*", *started(F.col("line"), labels), F.col("line").rlike(T.FENCE).alias("fence"))
    inside = F.coalesce(F.sum(F.col("fence").cast("int")).over(_in_order("spec", "section", end=-1)), F.lit(0)) % 2 == 1
    return rows.withColumn("fenced", inside & ~F.col("fence"))


def items(rows: DataFrame) -> DataFrame:
    """(spec, section, heading, role, at, start, end, text, origin, label) of the list items of ``scanned`` lines.

    An item goes on until a blank line or the next item that isn't deeper than it; deeper ones and wrapped lines belong to it.
    [start, end) is its range in the text, from behind the marker.
    """
    open_ = rows.filter(~F.col("fence") & ~F.col("fenced")).withColumn("blank", F.trim("line") == "")
    open_ = open_.withColumn("block", F.sum(F.col("blank").cast("int")).over(_in_order("spec", "section", end=0))).filter("not blank")
    block = ("spec", "section", "block")
    indent = F.length("line") - F.length(F.regexp_replace("line", r"^\s+", ""))
    least = F.min(F.when(F.col("origin").isNotNull(), indent)).over(_in_order(*block, end=-1))
    marked = open_.withColumn("new", F.col("origin").isNotNull() & (least.isNull() | (indent <= least)))
    marked = marked.withColumn("item", F.sum(F.col("new").cast("int")).over(_in_order(*block, end=0))).filter("item > 0")
    ended = F.col("at") + F.length(F.regexp_replace("line", r"\s+$", ""))
    piece = F.struct("line_no", F.when(F.col("new"), F.col("rest")).otherwise(F.trim("line")).alias("piece"))
    first = lambda c: F.min_by(c, "line_no")
    start = F.when(F.col("new"), ended - F.length(F.regexp_replace("rest", r"\s+$", "")))
    made = marked.groupBy("spec", "section", "block", "item").agg(
        first("heading").alias("heading"), first("role").alias("role"), first("origin").alias("origin"), first("label").alias("label"), F.min("at").alias("at"), F.min(start).alias("start"), F.max(ended).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["piece"]), " ").alias("text"),
    )
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"^\*\*(.+?)\*\*:?\s*", "$1: "), r"\s+", " "))
    fallback = F.coalesce(F.expr("element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in T.ORIGINS.items()) + "), role)"), F.lit("bullet-item"))
    out = made.select("spec", "section", "heading", "role", "at", "start", "end", clean.alias("text"), F.when(F.col("origin") == "plain", fallback).otherwise(F.col("origin")).alias("origin"), "label")
    return out.filter(F.length("text") >= T.LEAST_ITEM)


def paragraphs(rows: DataFrame) -> DataFrame:
    """(spec, section, heading, role, at, text): prose of ``scanned`` lines without items and what wraps them, fences, tables, quotes."""
    empty = (F.col("fenced") | (F.trim("line") == "")) & ~F.col("fence")
    starts = ~F.col("fence") & ~empty & F.col("origin").isNotNull()
    event = F.when(starts, 1).when(empty, 0)
    marked = rows.select("*", (F.col("fence") | empty | starts).alias("stop"), F.coalesce(F.last(event, ignorenulls=True).over(_in_order("spec", "section", end=0)), F.lit(0)).alias("in_list"))
    marked = marked.withColumn("part", F.sum(F.col("stop").cast("int")).over(_in_order("spec", "section", end=0)))
    prose = marked.filter(~F.col("stop") & (F.col("in_list") == 0) & ~F.trim("line").rlike(r"^(\||>|#{1,6}\s)"))
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("t")))), lambda x: x["t"]), " "))
    made = prose.groupBy("spec", "section", "part").agg(F.min_by("heading", "line_no").alias("heading"), F.min_by("role", "line_no").alias("role"), F.min("at").alias("at"), text.alias("text"))
    return made.filter(F.length("text") >= T.LEAST_STATEMENT).drop("part")


def sentences(body: DataFrame) -> DataFrame:
    """(spec, section, heading, role, at, nth, text): the sentences of body lines; blank lines, #-lines and bullets part blocks."""
    here = _in_order("spec", "section", end=0)
    bare = body.withColumn("t", F.trim("line"))
    stop, bullet = (F.col("t") == "") | F.startswith("t", F.lit("#")), F.col("t").rlike(T.PROSE_BULLET)
    marked = bare.withColumn("block", F.sum((stop | bullet).cast("int")).over(here)).filter(~stop)
    piece = F.struct("line_no", F.when(bullet, F.regexp_replace("t", T.PROSE_BULLET, "")).otherwise(F.col("t")).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), " ")
    blocks = marked.groupBy("spec", "section", "block").agg(F.min_by("heading", "line_no").alias("heading"), F.min_by("role", "line_no").alias("role"), F.min("at").alias("at"), text.alias("text"))
    each = blocks.select("spec", "section", "heading", "role", "at", F.posexplode(F.split("text", T.SENTENCE_END)).alias("nth", "text")).withColumn("text", F.trim("text"))
    return each.filter(F.length("text") >= T.LEAST_STATEMENT)


def guarded(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in T.GUARDS])


def unnamed(text: Column) -> Column:
    """Whether a statement draws a boundary around all that it doesn't name, and names nothing."""
    return text.rlike(T.BOUNDLESS) & (F.size(concepts(text)) == 0)


def directive(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"^[*_`\"'(\[]*([A-Za-z]+)", 1)).isin(*T.IMPERATIVE)


def verdict(text: Column) -> Column:
    """What a sentence of prose is: requirement, preservation, vague-preservation, uncertain or non-requirement."""
    demoted = reduce(lambda a, b: a | b, [text.rlike(p) for p in T.DEMOTING])
    return (
        F.when(F.endswith(text, F.lit("?")), "non-requirement").when(guarded(text), F.when(unnamed(text), "vague-preservation").otherwise("preservation"))
        .when(text.rlike(T.STRONG_MODAL) | directive(text), "requirement").when(demoted, "non-requirement").when(text.rlike(T.WILL), "requirement").otherwise("uncertain")
    )


def admission(text: Column) -> Column:
    """How sure it is that an admitted sentence is a requirement, by the sign that admitted it."""
    sure = T.CONFIDENCE
    guard = guarded(text) & ~unnamed(text)
    return F.when(guard, sure["guard"]).when(text.rlike(T.STRONG_MODAL), sure["modal"]).when(directive(text), sure["imperative"]).otherwise(sure["will"])


def extracted(specs: DataFrame, labels: str = T.LABEL) -> DataFrame:
    """(spec, kind, statement, heading, origin, label, intent, confidence, type, priority, start, end) of (spec, text).

    kind is requirement, constraint, question, context, implementation-note, non-goal or ambiguous. Where a text has any list of
    requirements (sections of that role, or labels of its author's anywhere), those are its requirements; else its prose is
    read sentence by sentence, with the confidence of the sign that admits each. start and end are the range of a list item.
    Of equal statements (whatever their case) the first is kept. ``labels`` is what an author's label looks like. A null text gives nothing. One text is one row, and so are
    its lines one group.
    """
    body = staged(sectioned(lines_of(specs.select("spec", "text"))))
    rows = staged(scanned(body, labels))
    role, text = F.col("role"), F.col("text")
    listed, prose = items(rows), paragraphs(rows)
    requiring = role.isin(*T.REQUIRING)
    boundary, none, no = (role == "preservation") & unnamed(text), F.lit(None), F.lit(None).cast("string")
    note = F.expr("element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in T.NOTED.items()) + "), role)")
    other = F.when(role == "constraints", "constraint").when(role == "open-questions", "question").otherwise(note)

    def told(df, kind, origin=no, label=no, start=none, end=none, confidence=none, intent=no, nth=F.lit(0)):
        return df.filter(kind.isNotNull()).select("spec", kind.alias("kind"), text.alias("statement"), "heading", origin.alias("origin"), label.alias("label"), intent.alias("intent"), confidence.cast("double").alias("confidence"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.col("at").cast("long").alias("at"), nth.alias("nth"))

    range_ = {"start": F.col("start"), "end": F.col("end")}
    keeps = F.when(role == "preservation", "preserve")
    wanted = F.when(requiring & ~boundary, "requirement").when(~requiring & (F.col("origin") == "explicit-label"), "requirement")
    guard = (role == "preservation") & guarded(text)
    structured = told(listed, wanted, F.col("origin"), F.col("label"), intent=keeps, **range_).unionByName(told(prose, F.when(guard & ~boundary, "requirement"), F.lit("prose-modal"), intent=keeps))
    first = W.partitionBy("spec", F.lower("statement")).orderBy("at", "nth")
    structured = staged(structured.withColumn("turn", F.row_number().over(first)).filter("turn = 1").drop("turn"))
    parts = [structured]
    parts += [told(df, F.when(boundary & (guard if df is prose else F.lit(True)), kind)) for df in (listed, prose) for kind in ("ambiguous", "question")]
    parts += [told(listed, F.when(~requiring, other), **range_), told(prose, F.when(~requiring, other).when(~guard, "context"))]
    loose = sentences(body).join(structured.select("spec").distinct(), "spec", "left_anti").filter(~role.isin(*T.CLOSED))
    said = verdict(text)
    strict = F.when(text.rlike(T.STRONG_MODAL) & said.isin("requirement", "preservation"), said).otherwise("non-requirement")
    loose = staged(loose.withColumn("verdict", F.when(role.isin(*T.STRICT), strict).otherwise(said)))
    is_ = F.col("verdict")
    admitted = told(loose, F.when(is_.isin("requirement", "preservation"), "requirement"), F.lit("prose-modal"), confidence=admission(text), intent=F.when(is_ == "preservation", "preserve"), nth=F.col("nth"))
    admitted = admitted.withColumn("turn", F.row_number().over(first)).filter("turn = 1").drop("turn")
    parts.append(admitted)
    parts += [told(loose, F.when(is_.isin("vague-preservation", "uncertain"), kind), nth=F.col("nth")) for kind in ("ambiguous", "question")]
    parts.append(told(loose, F.when((is_ == "non-requirement") & (role == "unknown"), "context"), nth=F.col("nth")))
    vague = structured.unionByName(admitted).filter((F.size(concepts(F.col("statement"))) == 0) & ~F.col("statement").rlike(T.VAGUE))
    parts.append(vague.select("spec", F.lit("ambiguous").alias("kind"), "statement", "heading", no.alias("origin"), no.alias("label"), no.alias("intent"), none.cast("double").alias("confidence"), none.cast("long").alias("start"), none.cast("long").alias("end"), "at", "nth"))
    every = reduce(DataFrame.unionByName, parts)
    asked = F.col("kind") == "requirement"
    return every.select(
        "spec", "kind", "statement", F.when(F.col("heading") != "", F.col("heading")).alias("heading"), "origin", "label", F.when(asked, F.coalesce("intent", F.lit("change"))).alias("intent"), "confidence",
        F.when(asked, S.requirement_type(F.col("statement"))).alias("type"), F.when(asked, S.priority(F.col("statement"))).alias("priority"), "start", "end",
    )


def quality(specs: DataFrame, drafts: DataFrame) -> DataFrame:
    """(spec, strategy, structured, prose, uncertain, provisional): how a text was read. uncertain is null where lists were."""
    asked = F.col("kind") == "requirement"
    prose = (F.col("origin") == "prose-modal") & F.col("confidence").isNotNull()
    vague = (F.col("kind") == "question") & ~unnamed(F.col("statement"))
    counts = drafts.groupBy("spec").agg(F.count_if(asked & ~prose).alias("structured"), F.count_if(asked & prose).alias("prose"), F.count_if(vague).alias("open"))
    rows = specs.select("spec").join(counts, "spec", "left").fillna(0, ["structured", "prose", "open"])
    uncertain = F.when(F.col("structured") == 0, F.col("open"))
    strategy = F.when(F.col("structured") > 0, F.when(F.col("prose") == 0, "structured").otherwise("partially-structured")).when(F.col("prose") > 0, "prose-modal").otherwise("prose-fallback")
    provisional = (F.col("structured") == 0) & (F.col("open") > F.col("prose")) & (F.col("open") > T.PROVISIONAL_OVER)
    return rows.select("spec", strategy.alias("strategy"), "structured", "prose", uncertain.alias("uncertain"), provisional.alias("provisional"))
