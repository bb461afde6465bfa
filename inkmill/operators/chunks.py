"""Splitting texts into token-bounded chunks, and the marker stream of parents and children."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WIDE, estimate_tokens, is_line_list_item, line_ends_sentence, quarter_tokens, starts_paragraph, strip

# Fixed values.
PARENT, CHILD, TITLE_LINE = "***", "<-split->", "文档名："
SENTENCE_BREAKS = "。！？；!?;"
LINE_BREAKS = "。！？!?"
MAX_TOKENS = 512


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hard_parts(text: Column, most: int) -> Column:
    """Parts of a text without regard to sentences, each cut where the next character would overflow it; the last may go on."""
    wide = lambda c: F.when(c.rlike(WIDE), 4).when(c.rlike(r"(?U)^[\s\x{1C}-\x{1F}]$"), 0).otherwise(1)
    state = lambda cuts, at, since: F.struct(cuts.alias("cuts"), at.alias("at"), since.alias("since"))
    fits = lambda s, w: s["since"] + w <= 4 * most
    step = lambda s, w: F.when(fits(s, w), state(s["cuts"], s["at"] + 1, s["since"] + w)).otherwise(state(F.concat(s["cuts"], F.array(s["at"])), s["at"] + 1, w))
    start = state(F.array().cast("array<int>"), F.lit(0), F.lit(0))
    cuts = lambda chars: F.aggregate(F.transform(chars, wide), start, step, lambda s: F.concat(F.array(F.lit(0)), s["cuts"], F.array(s["at"])))
    part = lambda chars, c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda a, i: F.array_join(F.slice(chars, a + 1, F.get(c, i + 1) - a), ""))
    return _let(F.split(text, ""), lambda chars: _let(cuts(chars), lambda c: part(chars, c)))


def _sentences(text: Column, most: int, breaks: str) -> Column:
    """The sentences of a text, or their parts where one is too long on its own, with their weights."""
    # A sentence ends behind one of the breaks, and between two line breaks.
    sentences = F.split(text, f"(?<=[{''.join(rf'\x{{{ord(c):X}}}' for c in breaks)}])|(?<=\n)(?=\n)")
    return F.flatten(F.transform(sentences, lambda x: _let(quarter_tokens(x), lambda w: F.when(w <= 4 * most, F.array(F.struct(x.alias("t"), w.alias("w"), F.lit(True).alias("whole")))).otherwise(
        F.transform(_hard_parts(x, most), lambda t: F.struct(t.alias("t"), quarter_tokens(t).alias("w"), F.lit(False).alias("whole")))))))


def split_by_rules(text: Column, most: int = MAX_TOKENS, breaks: str = SENTENCE_BREAKS) -> Column:
    """Parts of a text of at most ``most`` estimated tokens: cut at the last sentence end, else where it overflows.

    A fold over the sentences keeps the cuts and the weight (in quarter tokens) since the last cut; only sentences that are too long on their
    own are gone through by characters. Blank parts are dropped.
    """
    state = lambda cuts, at, since: F.struct(cuts.alias("cuts"), at.alias("at"), since.alias("since"))
    # Each part of a long sentence begins behind a cut, and so does a sentence that doesn't fit.
    joins = lambda s, x: x["whole"] & (s["since"] + x["w"] <= 4 * most)
    step = lambda s, x: F.when(joins(s, x), state(s["cuts"], s["at"] + 1, s["since"] + x["w"])).otherwise(state(F.concat(s["cuts"], F.array(s["at"])), s["at"] + 1, x["w"]))
    start = state(F.array().cast("array<int>"), F.lit(0), F.lit(0).cast("long"))
    cuts = lambda p: F.aggregate(p, start, step, lambda s: F.concat(F.array(F.lit(0)), s["cuts"], F.array(s["at"])))
    part = lambda p, c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda a, i: F.array_join(F.slice(p["t"], a + 1, F.get(c, i + 1) - a), ""))
    parts = _let(_sentences(text, most, breaks), lambda p: _let(cuts(p), lambda c: part(p, c)))
    kept = F.filter(F.transform(parts, strip), lambda p: p != "")
    whole = F.filter(F.array(strip(text)), lambda p: p != "")
    return F.when(estimate_tokens(text) <= most, whole).otherwise(kept)


def marker_explode(documents: DataFrame, source: str = "doc_id", text: str = "text", filename: Column | None = None) -> DataFrame:
    """(source, p_idx, c_idx, document) of marked texts: parents split at PARENT, children at CHILD.

    Indexes count blank pieces; blank pieces are dropped. Each child is led by the title: the line after 文档名：,
    or the file name.
    """
    name = filename if filename is not None else F.col(source).cast("string")
    body = F.array_join(F.filter(F.transform(F.split(F.col(text), "\n"), strip), lambda x: x != ""), "\n")
    named = F.get(F.filter(F.split(body, "\n"), lambda x: F.contains(x, F.lit(TITLE_LINE))), F.lit(0))
    title = F.coalesce(F.nullif(strip(F.replace(named, F.lit(TITLE_LINE), F.lit(""))), F.lit("")), name)
    parents = documents.select(F.col(source).alias("source"), title.alias("title"), F.posexplode(F.split(body, r"\*\*\*", -1)).alias("p_idx", "parent"))
    children = parents.select("source", "title", "p_idx", F.posexplode(F.split("parent", CHILD, -1)).alias("c_idx", "child")).withColumn("child", strip(F.col("child")))
    return children.where("child <> ''").select("source", "p_idx", "c_idx", F.concat("title", F.lit("\n"), "child").alias("document"))


def chunk_count(text: Column, marker: str = CHILD) -> Column:
    """Paragraphs that are a marker, one at least."""
    return F.greatest(F.size(F.filter(F.split(text, "\n"), lambda x: strip(x) == marker)), F.lit(1))


def merge_lines(lines: DataFrame, keys: list[str], order: str = "pos", text: str = "text") -> DataFrame:
    """Page lines joined to paragraphs: (keys, pos, text), pos being a paragraph's first line.

    Three passes of running counts: a paragraph begins at a numbered line; paragraphs go on where the one before doesn't
    end a sentence, unless a chapter begins; runs of short list items are joined by line breaks.
    """
    by_line = Window.partitionBy(*keys).orderBy(order)
    rows = lines.select(*keys, order, strip(F.col(text)).alias("line")).where("line <> ''")
    rows = rows.withColumn("g", F.sum(starts_paragraph(F.col("line")).cast("int")).over(by_line))
    rows = _joined(rows, keys, order, "line", "")
    ends_before = F.lag(line_ends_sentence(F.col("line"))).over(by_line)
    new = F.coalesce(ends_before, F.lit(True)) | (starts_paragraph(F.col("line")) & ~is_line_list_item(F.col("line")))
    rows = _joined(rows.withColumn("g", F.sum(new.cast("int")).over(by_line)), keys, order, "line", "")
    short = is_line_list_item(F.col("line")) & (F.length("line") <= 100)
    rows = rows.withColumn("item", short)
    fresh = ~(F.col("item") & F.coalesce(F.lag("item").over(by_line), F.lit(False)))
    return _joined(rows.withColumn("g", F.sum(fresh.cast("int")).over(by_line)), keys, order, "line", "\n").withColumnRenamed("line", text)


def _joined(rows: DataFrame, keys: list[str], order: str, text: str, between: str) -> DataFrame:
    pieces = F.array_sort(F.collect_list(F.struct(order, text)))
    grouped = rows.groupBy(*keys, "g").agg(pieces.alias("x"))
    return grouped.select(*keys, F.get(F.col("x")[order], F.lit(0)).alias(order), F.array_join(F.col("x")[text], between).alias(text))


def parent_threshold(blocks: DataFrame, key: str = "doc_id", ratio: float = 1.5, floor: float = 25.0) -> DataFrame:
    """(key, threshold): the upper median title height times ratio, floor at least; -1 where heights tell nothing."""
    sizes = blocks.where(F.col("height") > 0).groupBy(key).agg(F.array_sort(F.collect_list("height")).alias("h"))
    middle = F.get("h", F.floor(F.size("h") / 2).cast("int"))
    limit = F.greatest(middle * ratio, F.lit(floor))
    useless = (F.size("h") < 3) | (F.size(F.array_distinct("h")) <= 1) | ~F.exists("h", lambda x: x >= limit)
    return sizes.select(key, F.when(useless, -1.0).otherwise(limit).alias("threshold"))


def lead_ins(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks(key, chunk_idx, parent, child, ...) without those that go into the next, with bare and lead_in.

    A chunk is bare if it has no child; lead_in is the parent of the bare chunk that it takes up.
    """
    w = Window.partitionBy(key).orderBy("chunk_idx")
    rows = chunks.withColumn("bare", F.coalesce(strip(F.col("child")) == "", F.lit(True)))
    # In a run of childless chunks every second one is taken by the one before it.
    run = F.sum((~F.col("bare")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.coalesce(run, F.lit(0)))
    place = F.row_number().over(Window.partitionBy(key, "run").orderBy("chunk_idx"))
    rows = rows.withColumn("place", place).withColumn("last", F.lead("chunk_idx").over(w).isNull())
    rows = rows.withColumn("taken", F.col("bare") & (F.col("place") % 2 == 1) & ~F.col("last"))
    rows = rows.withColumn("lead_in", F.lag(F.when(F.col("taken"), F.col("parent"))).over(w))
    return rows.where("NOT taken").drop("run", "place", "last", "taken")


def merge_small(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunk_idx, parent, child): a childless chunk goes into the next, pairwise.

    Where both are childless, both parents' texts stay, one as the child.
    """
    child = F.when(F.col("lead_in").isNull(), F.col("child")).when(F.col("bare"), F.col("lead_in")).otherwise(F.concat("lead_in", F.lit("\n"), "child"))
    return lead_ins(chunks.select(key, "chunk_idx", "parent", "child"), key).select(key, "chunk_idx", "parent", child.alias("child"))


def turn_chunks(turns: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """Conversations as chunks: every question with the answers after it, up to the next question."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("p_idx", F.sum((F.col("role") == "user").cast("int")).over(w))
    text = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("t"))))
    joined = rows.groupBy("conv_id", "p_idx").agg(F.count("*").alias("n_turns"), text.alias("x"))
    return joined.select("conv_id", "p_idx", "n_turns", F.array_join(F.col("x")["t"], "\n").alias("text"))


_STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_strategy(name: str, chunker: Callable[[DataFrame], DataFrame]) -> None:
    """Add a chunker: a function from rows, documents(doc_id, text) or blocks of them, to chunks."""
    _STRATEGIES[name] = chunker


def get_strategy(name: str) -> Callable[[DataFrame], DataFrame]:
    """The chunker of that name; an unknown name gives the default one."""
    return _STRATEGIES.get(name, _STRATEGIES["default"])


def list_strategies() -> list[str]:
    return sorted(_STRATEGIES)


def _by_rules(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(split_by_rules(F.col("text"))).alias("chunk_idx", "chunk"))


def runs(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """rows with run, which counts up where a row with the flag follows one without it, and flagged."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("flagged", F.coalesce(flag, F.lit(False)))
    fresh = F.col("flagged") & ~F.coalesce(F.lag("flagged").over(w), F.lit(False))
    return rows.withColumn("_fresh", fresh).withColumn("run", F.sum(F.col("_fresh").cast("int")).over(w)).drop("_fresh")


register_strategy("rules", _by_rules)
register_strategy("none", lambda d: d.select("doc_id", F.lit(0).alias("chunk_idx"), F.col("text").alias("chunk")))
