"""Operator 9: line dedup by a log-template tree of fixed depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm import texts as T
from concordia.llm.scratch import Scratch

#: Template tree: the token count, then this many leading tokens.
DEPTH = 4
#: A template recurs from so many different texts on.
MIN_DOCS = 5
#: Shorter lines are left alone.
MIN_TOKENS = 3
#: A line has a template when this share of its tokens (in tenths) is constant.
CONSTANT_TENTHS = 6
LINE, TEMPLATE = ["line_hash", "line_check"], ["template", "template_check"]
#: Keys of eight to twenty bytes that may be broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def _even(text):
    """text with one blank for each gap inside a line and none at its ends.

    Plain searches tell which texts need it, so regular ones are not matched at all.
    """
    odd = text.startswith(" ") | text.endswith(" ")
    for part in ("  ", " \n", "\n ", "\t", "\r", "\f", "\x0b"):
        odd = odd | text.contains(part)
    gaps = F.regexp_replace(text, "[ \\t\\r\\f\\x0B]+", " ")
    return F.when(odd, F.trim(F.regexp_replace(gaps, " ?\n ?", "\n"))).otherwise(text)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, masked, leaf, line_hash, line_check of all lines with enough tokens; tokens with a digit are <*>.

    Lines and templates are known by 96 bits: of 64 alone, some of 10^12 lines would be taken for others.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where("text is not null")
    rows = rows.select("doc_id", "text_hash", _even(F.col("text")).alias("even"))
    rows = rows.withColumn("digits", F.col("even").rlike("[0-9]"))
    rows = rows.select("doc_id", "text_hash", "digits", F.posexplode(F.split("even", "\n")).alias("line_no", "line"))
    variable = F.regexp_replace("line", "[^ ]*[0-9][^ ]*", "<*>")
    masked = F.when(F.col("digits") & F.col("line").rlike("[0-9]"), variable).otherwise(F.col("line"))
    rows = rows.select("doc_id", "text_hash", "line_no", masked.alias("masked"))
    count = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    rows = rows.withColumn("n_tokens", count).where(F.col("n_tokens") >= MIN_TOKENS)
    lead = F.substring_index("masked", " ", DEPTH)
    return rows.withColumn("leaf", F.xxhash64("n_tokens", lead)).withColumn("line_hash", F.xxhash64("masked")).withColumn("line_check", F.hash("masked"))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash, word, bits: the lines to drop, as bits of 62-line words.

    A line's leaf is its token count and its leading tokens, tokens with digits being
    variable from the start.  Within a leaf a token is constant at its place if at
    least ``min_docs`` lines have it there, else it is generalised; lines with enough constant
    tokens and the same constants share a template.  A template that occurs in at least
    ``min_docs`` different texts is recurring: it stays where it comes first (smallest id and
    line) and is dropped elsewhere.  Copies of a text count once, so a text that only repeats
    as a whole keeps its lines.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(_lines(docs).select("doc_id", "text_hash", "line_no", "leaf", *LINE), "lines")
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"))
    leaves = scratch.keep(leaves.where((F.col("n") >= min_docs) & (F.col("lo") != F.col("hi"))).select("leaf"), "leaves")
    # One row for each different line of a leaf that may hold a recurring template.
    found = _lines(docs).join(_small(leaves), "leaf", "left_semi").groupBy("leaf", *LINE)
    found = scratch.keep(found.agg(F.min("masked").alias("masked"), F.count("*").alias("n")), "found")
    tokens = found.select("leaf", *LINE, "n", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    tokens = tokens.withColumn("token_hash", F.xxhash64("token"))
    constant = tokens.groupBy("leaf", "place", "token_hash").agg(F.sum("n").alias("support")).where(F.col("support") >= min_docs)
    marked = tokens.where("token <> '<*>'").join(constant, ["leaf", "place", "token_hash"]).select("leaf", *LINE, "place", "token_hash")
    shape = marked.groupBy("leaf", *LINE).agg(F.sort_array(F.collect_list(F.struct("place", "token_hash"))).alias("kept"))
    size, parts = F.size(F.split("masked", " ")), ("leaf", F.col("kept.place"), F.col("kept.token_hash"))
    templates = (
        found.join(shape, ["leaf", *LINE])
        .where(F.size("kept") * 10 >= size * CONSTANT_TENTHS)
        .select(*LINE, F.xxhash64(*parts).alias("template"), F.hash(*parts).alias("template_check"))
    )
    templates = scratch.keep(templates, "templates")
    placed = scratch.keep(lines.join(_small(templates), LINE).select("doc_id", "text_hash", "line_no", *TEMPLATE), "placed")
    texts = placed.groupBy(*TEMPLATE, "text_hash").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    recurring = texts.groupBy(*TEMPLATE).agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_docs)
    recurring = scratch.keep(recurring.select(*TEMPLATE, "first"), "recurring")
    scratch.drop("lines", "leaves", "found", "templates")
    gone = placed.join(_small(recurring), TEMPLATE).where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("first")))
    bit = F.expr("shiftleft(1L, line_no % 62)")
    return gone.groupBy("doc_id", "text_hash", F.floor(F.col("line_no") / 62).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def drop_templates(docs: DataFrame, min_docs: int = MIN_DOCS, counts: tuple[str, str] = ("__n_lines", "__n_dropped")) -> DataFrame:
    """docs with recurring lines taken out of ``text``, and the numbers of lines and of dropped lines.

    ``counts`` names the two numbers; a ValueError tells if docs has such a column.  Null texts
    stay null and empty ones empty; texts of any length count as a whole and may become empty;
    rows without an id are texts like others and come first; repeated rows are treated alike
    (a template's first place counts in each of them); other columns stay as they are, whatever
    their names; an empty table gives no rows.
    """
    if clash := {c.lower() for c in counts} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has {sorted(clash)} already: name the counts otherwise")
    own, of_id, of_hash, bits, kept_lines = T.fresh([*docs.columns, *counts], "own_hash", "of_id", "of_hash", "bits_of", "kept_lines")
    words = dropped_lines(docs, min_docs).groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))))
    words = words.toDF(of_id, of_hash, bits)
    joined = docs.withColumn(own, F.xxhash64("text")).join(words, (F.col(own) == F.col(of_hash)) & F.col("doc_id").eqNullSafe(F.col(of_id)), "left")
    lines = F.split("text", "\n")
    word = lambda i: F.coalesce(F.try_element_at(bits, F.floor(i / 62).cast("int")), F.lit(0).cast("long"))
    kept = F.filter(lines, lambda _, i: F.getbit(word(i), (i % 62).cast("int")) == 0)
    kept = F.when(F.col(bits).isNull(), lines).otherwise(kept)
    joined = joined.withColumn(kept_lines, kept)
    shown = {c: (F.array_join(kept_lines, "\n").alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns}
    return joined.select(
        *shown.values(),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size(lines) - F.size(kept_lines), F.lit(0)).cast("long").alias(counts[1]),
    )
