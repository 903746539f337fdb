"""Operator 1: chat formatting in budgeted, turn-aligned windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
#: Tokens that a turn in the template has at least, without role and text.
LEAST = 4


def escape(text):
    """Control strings cannot occur in the result; unescape() takes it back.

    Backslashes are doubled first; then "</" and "##" get a backslash between their
    two characters, so neither the end mark nor a heading mark is left.
    """
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("</"), F.lit("<\\/")), F.lit("##"), F.lit("#\\#"))


def unescape(text):
    """Drops each escaping backslash and keeps the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role, text):
    """A turn in the template; a colon in a role is escaped as it ends the heading."""
    head = F.replace(escape(role), F.lit(":"), F.lit("\\:"))
    return F.concat(F.lit("### "), head, F.lit(": "), escape(text), F.lit(END))


def _segments(turns: DataFrame, segment: int) -> DataFrame:
    """conv_id, segment, turns: each conversation in order, cut every ``segment`` turns.

    Turns are sorted within ranges of turn numbers.  Only the ranges' counts pass a window
    over the whole conversation; they tell at which rank a range starts.
    """
    mark = F.when(F.col("role") == "system", 0).otherwise(1)
    ranges = turns.withColumn("range", F.floor(F.col("turn") / segment))
    held = ranges.groupBy("conv_id", "range").agg(F.sort_array(F.collect_list(F.struct("turn", mark.alias("late"), "role", "text"))).alias("held"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranges.groupBy("conv_id", "range").count().withColumn("rank", F.sum("count").over(earlier))
    ranks = ranks.where("rank > 0").select(F.col("conv_id").alias("of_id"), F.col("range").alias("of_range"), "rank")
    held = held.join(ranks, F.col("conv_id").eqNullSafe(F.col("of_id")) & F.col("range").eqNullSafe(F.col("of_range")), "left")
    held = held.withColumn("rank", F.coalesce("rank", F.lit(0).cast("long")))
    cut = held.withColumn("segment", F.explode(F.expr(f"sequence(rank div {segment}, (rank + size(held) - 1) div {segment})")))
    piece = F.expr(f"""slice(held, int(greatest(segment * {segment} - rank, 0)) + 1,
        int(least(rank + size(held), (segment + 1) * {segment}) - greatest(rank, segment * {segment})))""")
    pieces = F.sort_array(F.collect_list(F.struct("rank", piece.alias("piece"))))
    return cut.groupBy("conv_id", "segment").agg(F.flatten(F.transform(pieces, lambda p: p.piece)).alias("turns"))


def format_chats(conversations: DataFrame, budget: int = 1024, history: int = 128, segment: int = 256) -> DataFrame:
    """One row per window of at most ``budget`` tokens (a quarter of the UTF-8 bytes).

    Prefix sums of the turns' tokens choose spans that start and end at turns.  A window
    repeats the conversation's system turn and, from the window before it, the last turns
    that fit in ``history`` tokens.  Repeated turns carry no loss; every assistant turn
    carries it in the one window that brings it first.

    Conversations are cut every ``segment`` turns (by rank; more, if the history can hold so
    many), so no task holds a whole long conversation.  The first window after a cut repeats
    the longest end of the turns before it that fits.  Null roles and texts are empty, null turns come first,
    repeated rows stay, ties go by role and text; null ids form one conversation.  A turn
    above the budget has a window of its own (``over_budget``).  Columns other than
    conv_id, turn, role and text are ignored.  An empty table gives no windows.
    """
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # The system turn, if the conversation opens with one: one small row per conversation.
    system = (
        turns.groupBy(F.col("conv_id").alias("sys_id"))
        .agg(F.min(F.struct("turn", F.when(F.col("role") == "system", 0).otherwise(1).alias("late"), "role", "text")).alias("first"))
        .where(F.col("first.role") == "system")
        .select("sys_id", F.col("first.text").alias("sys_text"))
    )
    # As many turns as can fit in the history never reach over a whole segment.
    most = history // LEAST
    parts = _segments(turns, max(segment, most + 1))
    made = F.transform(
        "turns",
        lambda t: F.struct(
            t.role.alias("role"),
            render(t.role, t.text).alias("shown"),
            F.char_length(escape(t.text)).cast("long").alias("chars"),
        ),
    )
    tokens = lambda shown: F.ceil(F.octet_length(shown) / 4)
    parts = parts.select("conv_id", "segment", made.alias("turns"))
    tail = F.expr(f"""filter(slice(turns, greatest(size(turns) - {most} + 1, 1), {most}), (t, i) -> aggregate(
        slice(turns, greatest(size(turns) - {most} + 1, 1) + i, size(turns)), 0L,
        (n, u) -> n + ceil(octet_length(u.shown) / 4)) <= {history} and t.role != 'system')""")
    before = parts.select(
        F.col("conv_id").alias("old_id"), (F.col("segment") + 1).alias("old_segment"), tail.alias("tail")
    )
    parts = (
        parts.join(system, F.col("conv_id").eqNullSafe(F.col("sys_id")), "left")
        .join(before, F.col("conv_id").eqNullSafe(F.col("old_id")) & (F.col("segment") == F.col("old_segment")), "left")
        .withColumn("sys_shown", render(F.lit("system"), F.col("sys_text")))
        .withColumn("opens", F.col("segment") == 0)
        .withColumn("tail", F.coalesce("tail", F.expr("slice(turns, 1, 0)")))
        .withColumn("room", F.lit(budget - history) - F.coalesce(tokens(F.col("sys_shown")), F.lit(0)))
    )
    # upto[i]: tokens of the first i turns.
    parts = parts.withColumn(
        "upto",
        F.aggregate(
            F.transform("turns", lambda t: tokens(t.shown)),
            F.array(F.lit(0).cast("long")),
            lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
        ),
    )
    starts = F.aggregate(
        F.sequence(F.lit(1), F.size("turns")),
        F.array(F.lit(0)),
        lambda acc, i: F.when(
            (F.get("upto", i) - F.get("upto", F.element_at(acc, -1)) > F.col("room")) & (i - 1 > F.element_at(acc, -1)),
            F.concat(acc, F.array(i - 1)),
        ).otherwise(acc),
    )
    parts = parts.withColumn("starts", starts)
    spans = F.transform(
        "starts",
        lambda s, k: F.struct(
            k.alias("window"), s.alias("begin"), F.coalesce(F.get("starts", k + 1), F.size("turns")).alias("end"),
            F.coalesce(F.get("starts", k - 1), F.lit(0)).alias("old"),
        ),
    )
    one = parts.select("*", F.explode(spans).alias("span")).select("*", "span.*")
    # The longest run of turns just before the window that fits in the history.
    inside = F.expr(f"""slice(turns, 1 + greatest(old, begin - size(filter(
        slice(upto, 1 + old, begin - old), p -> upto[begin] - p <= {history}))), size(filter(
        slice(upto, 1 + old, begin - old), p -> upto[begin] - p <= {history})))""")
    carried = F.when(F.col("begin") == 0, F.col("tail")).otherwise(inside)
    has_system = F.col("sys_shown").isNotNull() & ~(F.col("opens") & (F.col("begin") == 0))
    # A history that reaches back to the system turn holds it already.
    carried = F.filter(carried, lambda t: ~F.coalesce(F.col("sys_shown") == t.shown, F.lit(False)))
    lead = F.when(
        has_system,
        F.array(F.struct(F.lit("system").alias("role"), F.col("sys_shown").alias("shown"), F.char_length(escape(F.col("sys_text"))).cast("long").alias("chars"))),
    ).otherwise(F.expr("slice(turns, 1, 0)"))
    one = (
        one.withColumn("repeats", F.concat(lead, carried))
        .withColumn("fresh", F.expr("slice(turns, begin + 1, end - begin)"))
        .withColumn("formatted", F.concat(F.array_join("repeats.shown", ""), F.array_join("fresh.shown", "")))
        .withColumn("skip", F.char_length(F.array_join("repeats.shown", "")).cast("long"))
    )
    ends = F.aggregate(
        F.col("fresh"),
        F.array(F.col("skip")),
        lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(t.shown))),
    )
    one = one.withColumn("ends", ends)
    loss = F.filter(
        F.transform(
            "fresh",
            lambda t, i: F.struct(
                t.role.alias("role"),
                (F.get("ends", i + 1) - len(END) - t.chars).alias("start"),
                t.chars.alias("chars"),
            ),
        ),
        lambda s: s.role == "assistant",
    )
    return one.select(
        "conv_id",
        "segment",
        "window",
        F.size("repeats").alias("n_repeated"),
        "formatted",
        F.transform(loss, lambda s: F.struct(s.start.alias("start"), s.chars.alias("chars"))).alias("loss"),
        tokens(F.col("formatted")).alias("n_tokens"),
        (tokens(F.col("formatted")) > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Each window's new turns and the texts under its loss mask, parsed from ``formatted``."""
    heading = r"(?s)^### ((?:[^:\\]|\\.)*+): (.*)$"
    pieces = F.expr("split(formatted, '</turn>\\n')")
    new = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    turns = F.transform(
        new,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, heading, 1)).alias("role"),
            unescape(F.regexp_extract(p, heading, 2)).alias("text"),
        ),
    )
    loss = F.transform(
        "loss", lambda s: unescape(F.substring("formatted", (s.start + 1).cast("int"), s.chars.cast("int")))
    )
    return windows.select("conv_id", "segment", "window", "formatted", turns.alias("turns"), loss.alias("targets"))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, what was read back: counts and digests.

    A digest needs a conversation's text in one row; the windows themselves do not.
    """
    back = read_back(windows).select(
        "conv_id",
        "segment",
        "window",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    rows = F.sort_array(F.collect_list(F.struct("segment", "window", "said", "loss")))
    return (
        back.groupBy("conv_id")
        .agg(F.sum("n").cast("long").alias("n_turns"), rows.alias("r"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id",
            "n_turns",
            F.sha2(F.array_join("r.said", ""), 256).alias("turns_sha256"),
            F.char_length(F.array_join("r.loss", "")).cast("long").alias("loss_chars"),
            F.sha2(F.array_join("r.loss", ""), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
