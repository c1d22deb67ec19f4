"""Line dedup by a log-template tree, in DataFrame operations only.

A line is cut into tokens at white space; a token with a digit is a variable field, ``<*>``. The tree has a fixed
depth: the number of tokens, then the ``DEPTH`` leading tokens. In a leaf all lines have equally many tokens, so the
most frequent token of each place makes up the leaf's template. A line belongs to it if, beyond the leading tokens,
at least ``SIMILAR`` of its tokens agree; places where they differ are variable fields, too.

Lines that a leaf's first template leaves over may have templates of their own. They are found by blocks: two texts
that agree in enough places agree in the whole of at least one of so many blocks, so lines with an equal block are a
group. Each line joins its largest group, all groups of all leaves at once; the most frequent tokens of a group's lines,
if they occur twice at their place, make its template, and the lines that agree with it belong to it. Lines that don't
have one more turn among themselves: ``TURNS`` in all, whatever the data. Any other line is its own template, apart from
its digits.

A template recurs if lines of two documents belong to it. Its first line (smallest doc_id, then place) stays, and all
others are dropped, so that of copied passages one is left. Lines of fewer than ``SHORTEST`` tokens, or with fewer
that are no variable fields, are never dropped.

Equal lines are summed up before anything is compared, and what is compared are places with their leaf's template,
never lines with each other, so neither common lines nor large leaves multiply.

Null texts stay null; empty texts have no lines to drop. In :func:`dedup`, a document that loses all its lines goes,
as copies of an earlier one do; others keep all their columns, whatever their names. Repeated rows count as one
document. Rows without a doc_id are left alone. Empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small

DEPTH = 3
SIMILAR_PERCENT = 70
SHORTEST = 4
FIELD = "<*>"
#: How often lines without a template look for one among themselves.
TURNS = 2
#: Rows of ids or places that may be sent to every task; more are joined by a shuffle.
MOST_SHIPPED = 500_000


def _normal(line: Column) -> Column:
    """Single spaces between tokens, and <*> for tokens with digits."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c")
    spaced = F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\r\x0b\x0c]+", " ")).otherwise(line))
    return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(spaced)


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _fields(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(FIELD), F.lit("")))) / len(FIELD)


def parsed(docs: DataFrame, depth: int = DEPTH, shortest: int = SHORTEST) -> DataFrame:
    """Lines of at least ``shortest`` tokens: doc_id, line_no from 0, n tokens, leaf and same (hashes of the leaf and the line)."""
    each = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), _normal)).alias("line_no", "line"))
    each = each.where(F.octet_length("line") >= 2 * shortest - 1).withColumn("n", _spaces(F.col("line")) + 1)
    each = each.where((F.col("n") - F.when(F.col("line").contains(FIELD), _fields(F.col("line"))).otherwise(0)) >= shortest)
    leaf = F.xxhash64("n", F.substring_index("line", " ", depth))
    return each.select("doc_id", "line_no", "n", leaf.alias("leaf"), F.xxhash64("line", F.lit(7)).alias("same"))


def templates(docs: DataFrame, lines: DataFrame, scratch: Scratch, depth: int = DEPTH, similar: int = SIMILAR_PERCENT) -> DataFrame:
    """Of the parsed lines of docs, those (leaf, same) whose template recurs, with its first place: first_doc, first_line."""
    distinct = scratch.keep(
        lines.groupBy("leaf", "same").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.max("doc_id").alias("last_doc"), F.min("n").alias("n")), "lines"
    )
    mixed = distinct.groupBy("leaf").agg(F.count("*").alias("many")).where("many > 1").select("leaf")
    open_ = scratch.keep(distinct.join(mixed, "leaf").select("leaf", "same", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no")), "open")
    ids = broadcast_if_small(scratch.keep(open_.select("doc_id").distinct(), "ids"), MOST_SHIPPED)
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    spelled = texts.join(broadcast_if_small(open_, MOST_SHIPPED), ["doc_id", "line_no"]).select("leaf", "same", "n", F.split(_normal(F.col("line")), " ").alias("tokens"))
    spelled = scratch.keep(spelled.where(F.size("tokens") == F.col("n")), "spelled")

    places = spelled.select("leaf", F.posexplode("tokens").alias("place", "token")).where(F.col("place") >= depth)
    common = places.groupBy("leaf", "place", "token").agg(F.count("*").alias("many"))
    common = common.groupBy("leaf", "place").agg(F.max(F.struct("many", "token")).alias("top"))
    consensus = common.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("place", F.col("top.token").alias("token")))).alias("template"))
    agreeing = F.size(F.filter(F.zip_with(F.slice("tokens", depth + 1, F.col("n")), F.col("template.token"), lambda x, y: x == y), lambda x: x))
    alike = scratch.keep(spelled.join(consensus, "leaf").where(100 * agreeing >= similar * (F.col("n") - depth)).select("leaf", "same").distinct(), "alike")
    shared = alike.groupBy("leaf").agg(F.count("*").alias("many")).where("many > 1").select("leaf")
    first = alike.join(shared, "leaf", "left_semi").select("leaf", "same", F.lit(0).cast("long").alias("template"))
    over = spelled.join(first, ["leaf", "same"], "left_anti").dropDuplicates(["leaf", "same"])
    found = first.unionByName(_further(scratch.keep(over, "over"), scratch, depth, similar))

    member = distinct.join(found, ["leaf", "same"], "left").withColumn("template", F.coalesce("template", "same"))
    whole = member.groupBy("leaf", "template").agg(F.min("first").alias("start"), F.max("last_doc").alias("end_doc")).where("start.doc_id < end_doc")
    return member.join(whole, ["leaf", "template"]).select("leaf", "same", F.col("start.doc_id").alias("first_doc"), F.col("start.line_no").alias("first_line"))


def _blocks(tokens: str, places: Column, similar: int) -> Column:
    """The place and tokens of each block of an array of so many places, one more block than places may differ."""
    blocks = F.floor(places * (100 - similar) / 100).cast("int") + 1
    start = lambda j: F.floor(j * places / blocks).cast("int")
    block = lambda j: F.array_join(F.slice(tokens, start(j) + 1, start(j + 1) - start(j)), " ")
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.concat_ws(":", j.cast("string"), block(j)))


def _further(over: DataFrame, scratch: Scratch, depth: int, similar: int) -> DataFrame:
    """leaf, same, template of those distinct lines that belong to a further template with another one."""
    places = F.col("n") - depth
    left = over.where(places * (100 - similar) >= 100).select("leaf", "same", F.slice("tokens", depth + 1, places).alias("tokens"))
    left = scratch.keep(left, "left")
    found = []
    for turn in range(TURNS):
        keyed = left.select("leaf", "same", F.explode(_blocks("tokens", F.size("tokens"), similar)).alias("key"))
        groups = keyed.groupBy("leaf", "key").agg(F.count("*").alias("many")).where("many > 1")
        best = keyed.join(groups, ["leaf", "key"]).groupBy("leaf", "same").agg(F.max(F.struct("many", "key")).alias("top"))
        member = scratch.keep(best.select("leaf", "same", F.col("top.key").alias("key")).join(left, ["leaf", "same"]), "members")
        common = member.select("leaf", "key", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "key", "place", "token").agg(F.count("*").alias("many"))
        common = common.groupBy("leaf", "key", "place").agg(F.max(F.struct("many", "token")).alias("top"))
        token = F.when(F.col("top.many") > 1, F.col("top.token"))
        made = common.groupBy("leaf", "key").agg(F.sort_array(F.collect_list(F.struct("place", token.alias("token")))).alias("wanted"))
        agreeing = F.size(F.filter(F.zip_with("tokens", F.col("wanted.token"), lambda x, y: x == y), lambda x: x))
        fits = scratch.keep(member.join(made, ["leaf", "key"]).where(100 * agreeing >= similar * F.size("tokens")).select("leaf", "same", "key"), "fits")
        several = fits.groupBy("leaf", "key").agg(F.count("*").alias("size")).where("size > 1").select("leaf", "key")
        taken = fits.join(several, ["leaf", "key"], "left_semi").select("leaf", "same", F.xxhash64(F.lit(turn + 1), "key").alias("template"))
        found.append(scratch.keep(taken, "found"))
        rest = scratch.keep(left.join(found[-1], ["leaf", "same"], "left_anti"), "left") if turn < TURNS - 1 else left
        for old in (member, fits, *([left] if rest is not left else [])):
            scratch.drop(old)
        left = rest
    return reduce(DataFrame.unionByName, found)


def recurring_lines(docs: DataFrame, depth: int = DEPTH, similar: int = SIMILAR_PERCENT, shortest: int = SHORTEST) -> DataFrame:
    """doc_id and dropped, the sorted numbers of its lines that go, for documents that lose any."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(parsed(docs, depth, shortest), "parsed")
    recurring = scratch.keep(templates(docs, lines, scratch, depth, similar), "templates")
    found = lines.select("doc_id", "line_no", "leaf", "same").join(recurring, ["leaf", "same"])
    gone = found.where((F.col("doc_id") != F.col("first_doc")) | (F.col("line_no") != F.col("first_line")))
    out = scratch.keep(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped")), "dropped")
    scratch.drop_all_but(out)
    return out


def dedup(docs: DataFrame, depth: int = DEPTH, similar: int = SIMILAR_PERCENT, shortest: int = SHORTEST) -> DataFrame:
    """The documents without their recurring lines; those that had no other lines go."""
    gone = recurring_lines(docs.select("doc_id", "text"), depth, similar, shortest)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id").join(broadcast_if_small(gone, MOST_SHIPPED, "size(dropped)"), "doc_id", "left")
    all_lines = F.split("row.text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n"))
    left = rows.withColumn("text", text).where(F.col("dropped").isNull() | (F.trim(F.replace("text", F.lit("\n"), F.lit(" "))) != ""))
    return left.select(*(F.col("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns))
