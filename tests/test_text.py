"""Golden texts of the cleaning functions, and regressions."""

import pytest
from pyspark.sql import functions as F

from marlspike.functions import parse, text


def one(spark, value, step):
    return spark.createDataFrame([(value,)], "t string").select(step(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("step", "given", "wanted"),
    [
        (text.compress_blank_lines, "\t\n \nfirst\n\nsecond\n\t \n\n \nthird\n\n", "\nfirst\n\nsecond\n\nthird\n\n"),
        (text.compress_blank_lines, "x", "x\n"),
        (text.fix_cjk_spacing, "go 東 京\tへ 1 春 夏秋  冬 end", "go 東京\tへ 1 春夏秋  冬 end"),
        (text.strip_zero_width, "‎​one⁠two‮﻿", "onetwo"),
        (text.filter_table_rows, "  |   | |\n||\n| --- |\n  | : | - |\n| \t |x|", "| --- |\n  | : | - |\n| \t |x|"),
        (text.strip_token_stats, "(3in/0out tokens) lead", "lead"),
        (text.strip_token_stats, "a (1in/2out tokens) (b)", "a (1in/2out tokens) (b)"),
        (text.dedup_adjacent_lines, "abcd\nabcd\nabcde\n  abcde\t\nabcde\né é\né é\nabcde", "abcd\nabcd\nabcde\né é\nabcde\n"),
        (text.remove_watermarks, " note 7\nA\nnote 7\t\nB\n\tnote 7 \nnote\nnote\nC", "A\nB\nnote\nnote\nC"),
        (text.remove_watermarks, "\n".join(["w" * 80] * 3 + ["v" * 79] * 2), "\n".join(["w" * 80] * 3 + ["v" * 79] * 2)),
        (text.compress_spaces, "\t tab  first\n 　 two　　words \n\t\t\nx\ty", "\t tab first\n 　 two words\n\nx y"),
        (text.remove_template_lines, "電話：  住所：\nroom:  floor: \nroom: 3 floor:\na: b: c", "room:  floor: \nroom: 3 floor:\na: b: c"),
        (text.strip_heartbeat, "If nothing needs attention\nwell\n Current time: now\n\n\t\nDo not infer it\nDo not\nWhen reading HEARTBEAT.md in a workspace\nDo not read\nFollow it strictly", "If nothing needs attention\nwell\nDo not"),
        (text.strip_heartbeat, "\n\nWhen reading HEARTBEAT.md\nCurrent time:", "\n\nWhen reading HEARTBEAT.md"),
        (text.trim_trailing, "one\r\n\r\n two \t\r\nthree\r", "one\n\n two\nthree"),
        (text.clean_memory, "", ""),
        (text.clean_knowledge, "表 头 一\t\n| |\n|  a  |\n\n\n\nmark\nline  one​ \nline one\nmark\n  in  dent\nmark\n住所： 電話：\n", "表头一\n|  a  |\n\nline one\n  in dent\n".replace("|  a  |", "| a |")),
        (text.clean_session, "Read HEARTBEAT.md\n\nDo not read it\nuser: hello ​\nuser: hello\n\n\n\nassistant: so⁠ it is\t\nCurrent time: 5\n", "user: hello \nuser: hello\n\nassistant: so it is\n"),
    ],
)
def test_cleaning(spark, step, given, wanted):
    assert one(spark, given, step) == wanted


def test_steps_can_be_left_out(spark):
    off = text.CleanConfig(trailing_spaces=False, zero_width=False, blank_lines=False)
    assert one(spark, "a  \n\n\nb​", lambda c: text.clean_memory(c, off)) == "a  \n\n\nb​"


def test_empty_sessions(spark):
    assert one(spark, "tool: nothing said", text.is_empty_session)
    assert not one(spark, "x\n  codex:", text.is_empty_session)
    assert one(spark, "é" * 25, text.is_empty_session) and not one(spark, "é" * 25 + "x", text.is_empty_session)


def test_tiny_is_in_bytes(spark):
    assert one(spark, "é" * 24, text.is_tiny)
    assert not one(spark, "é" * 25, text.is_tiny)


def test_frontmatter_and_title(spark):
    value = "---\ntitle: A: b\ntags: x, y ,,z\n---\n# Head\nbody"
    meta = one(spark, value, lambda c: parse.frontmatter(c)[0])
    assert meta == {"title": "A: b", "tags": "x, y ,,z"}
    assert one(spark, value, lambda c: parse.frontmatter(c)[1]) == "# Head\nbody"
    assert one(spark, value, lambda c: parse.title(*parse.frontmatter(c), F.lit("/a/b.md"))) == "A: b"
    assert one(spark, "# Only\nx", lambda c: parse.title(*parse.frontmatter(c), F.lit("/a/b.md"))) == "Only"
    assert one(spark, "plain", lambda c: parse.title(*parse.frontmatter(c), F.lit("/a/b.tar.gz"))) == "b.tar"
    assert one(spark, "x, y ,,z", parse.csv_tags) == ["x", "y", "z"]


@pytest.mark.parametrize(("size", "overlap"), [(10, 2), (3, 0), (5, 4)])
@pytest.mark.parametrize("value", ["", "a", "abcdefghij", "This is a test sentence here"])
def test_fixed_chunks_are_those_of_a_loop(spark, value, size, overlap):
    wanted, start = [], 0
    while start < len(value):
        wanted.append(value[start : start + size])
        if start + size >= len(value):
            break
        start += size - overlap
    assert one(spark, value, lambda c: parse.fixed_chunks(c, size, overlap)) == wanted


def test_overlap_must_be_less_than_the_size():
    with pytest.raises(ValueError):
        parse.fixed_chunks(None, 5, 5)


def test_paragraph_chunks(spark):
    value = "aaaa\n\nbbbb\n\ncccccccccccc\n\nd"
    assert one(spark, value, lambda c: parse.paragraph_chunks(c, 10)) == ["aaaa\n\nbbbb", "cccccccccccc", "d"]


@pytest.mark.parametrize("n", range(1, 9))
def test_prefix_ends_with_a_whole_character(spark, n):
    value = "aé€😀z"
    assert one(spark, value, lambda c: parse.utf8_prefix(c, n)) == value.encode()[:n].decode("utf-8", "ignore")


def test_bad_json_is_no_tags(spark):
    assert one(spark, "bad", parse.tags) == []
    assert one(spark, None, parse.tags) == []
    assert not one(spark, None, parse.is_vectorized)


def test_findings(spark):
    assert one(spark, "sk-1 password= -----BEGIN", parse.findings) == ["Potential API key detected", "Potential password detected", "Private key detected"]


def test_memory_types(spark):
    assert [one(spark, v, parse.parse_memory_type) for v in ("style_guide", "decision", "nonsense")] == ["rules_standards", "decision", "semantic"]


def test_merge_texts(spark):
    merged = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(text.merge_texts(F.col("a"), F.col("b")).alias("r")).first().r
    assert merged("x\ny", "x\ny\nz") == "x\ny\nz"
    assert merged("x\ny", "p\nq") == "x\ny\n\np\nq"
    assert merged(" ", "p") == "p"


def test_garbage_and_readable(spark):
    assert one(spark, "", text.is_binary_garbage)
    assert one(spark, "\u0001\u0002\u0003\u0004\u0005\u0006\u0007abc", text.is_binary_garbage)
    assert not one(spark, "A plain sentence.", text.is_binary_garbage)
    assert one(spark, "one two three four five six", text.is_readable)
    assert not one(spark, "JFIF one two three four five six", text.is_readable)


def test_white_space_of_all_kinds(spark):
    """The set that is trimmed is the class that the patterns name."""
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in every], "c string")
    in_class = {r.c for r in rows.where(F.col("c").rlike(f"^[{text.SPACE}]$") & (F.col("c") != "\n")).collect()}
    assert in_class == set(text.SPACES)
    assert {r.c for r in rows.where(F.col("c").rlike(f"[{text.NOT_PLAIN}]")).collect()} == in_class - {" "}
    assert {r.c for r in rows.where(text.trim(F.col("c")) == "").collect()} == in_class | {"\n"}
    assert {r.c for r in rows.where(text.strip_zero_width(F.col("c")) == "").collect()} == set(text.ZERO_WIDTH)


def test_merge_of_long_texts_reads_the_second_once(spark):
    """Seconds grow with the text; when the second one was put together again for each line, this took 40,000 copies of 1 MB."""
    a = "\n".join(f"line {i} of many" for i in range(40_000))
    b = F.concat(F.col("t"), F.lit("\nmore"))
    plan = spark.createDataFrame([(a,)], "t string").select(text.merge_texts(F.col("t"), b).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(t#") == 1
