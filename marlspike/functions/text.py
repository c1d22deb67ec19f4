"""Text cleaning as Column expressions. Lengths that the rules give in bytes are bytes of UTF-8."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space (also beyond ASCII; but for the plain space; as a string), as CJK, and which code points have no width.
SPACE = r" \t\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NOT_PLAIN = r"\t\x0B\f\r\x{85}\x{A0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
SPACES = " \t\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{2E80}-\x{2EFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
ZERO_WIDTH = "\u200B\u200C\u200D\u200E\u200F\uFEFF\u202A\u202B\u202C\u202D\u202E\u2060\u2061\u2062\u2063\u2064"
HEARTBEAT_START = ("Read HEARTBEAT.md", "Follow it strictly", "Current time:")
HEARTBEAT_MORE = ("If nothing needs attention", "reply HEARTBEAT_OK", "Do not infer", "Do not read")
BINARY_MARKERS = ("cHRM", "IDAT", "IHDR", "PLTE", "gAMA", "sRGB", "JFIF", "Exif", "ICC_PROFILE", "GIF89", "GIF87", "RIFF", "WEBP", "tEXtSoftware", "[Content_Types]", "_rels/", "theme/", "MSWordDoc", "Word.Document", "KSOProductBuildVer")
SESSION_SPEAKERS = ("assistant", "gemini", "codex", "openclaw")


@dataclass(frozen=True)
class CleanConfig:
    """Which steps run, and the sizes in bytes below which documents are tiny and sessions empty."""

    blank_lines: bool = True
    trailing_spaces: bool = True
    zero_width: bool = True
    adjacent_lines: bool = True
    cjk_spacing: bool = True
    watermarks: bool = True
    template_lines: bool = True
    spaces: bool = True
    table_rows: bool = True
    heartbeat: bool = True
    tiny_bytes: int = 50
    empty_session_bytes: int = 50


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def trim(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(text, F.lit(SPACES + "\n"))


def unbroken(text: Column) -> Column:
    """Without a last line feed, and without carriage returns at line ends."""

    def cut(t: Column) -> Column:
        whole = F.when(t.endswith("\n"), F.left(t, F.char_length(t) - 1)).otherwise(t)
        return F.when(t.contains("\r"), F.regexp_replace(whole, r"\r(?=\n|\z)", "")).otherwise(whole)

    return bind(text, cut)


def lines(text: Column) -> Column:
    """Lines as an array; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(unbroken(text), "\n"))


def joined(parts: Column, close: bool = False) -> Column:
    """Lines put together again, with a line feed after the last one if wanted."""
    out = F.array_join(parts, "\n")
    return F.when(F.size(parts) > 0, F.concat(out, F.lit("\n"))).when(parts.isNotNull(), "") if close else out


def compress_blank_lines(text: Column) -> Column:
    return F.when(text == "", "").otherwise(F.regexp_replace(F.concat(unbroken(text), F.lit("\n")), rf"(?dm)^(?:[{SPACE}]*\n)+", "\n"))


def trim_trailing(text: Column) -> Column:
    return joined(F.transform(F.split(unbroken(text), "\n"), lambda line: F.rtrim(line, F.lit(SPACES))))


def strip_zero_width(text: Column) -> Column:
    # most characters lie below all of them and fail the first test
    return F.regexp_replace(text, rf"[\x{{200B}}-\x{{FEFF}}&&[{ZERO_WIDTH}]]+", "")


def dedup_adjacent_lines(text: Column) -> Column:
    """Drops a line of at least five bytes that equals the line before it, white space at the ends aside."""

    def kept(all_lines: Column, trimmed: Column) -> Column:
        same = lambda i: (i > 0) & (F.octet_length(F.get(trimmed, i)) >= 5) & (F.get(trimmed, i) == F.get(trimmed, i - 1))
        return F.filter(all_lines, lambda line, i: ~same(i))

    return bind(bind(lines(text), lambda all_lines: bind(F.transform(all_lines, trim), lambda trimmed: kept(all_lines, trimmed))), lambda parts: joined(parts, close=True))


def fix_cjk_spacing(text: Column) -> Column:
    return F.regexp_replace(text, rf" (?<=[{CJK}] )(?=[{CJK}])", "")


def remove_watermarks(text: Column, most_bytes: int = 80, times: int = 3) -> Column:
    """Drops short lines that occur at least three times; a text without any stays as it is."""

    def kept(all_lines: Column, often: Column) -> Column:
        return F.when(F.size(often) > 0, joined(F.filter(all_lines, lambda line: ~F.array_contains(often, trim(line))))).otherwise(text)

    def repeated(all_lines: Column) -> Column:
        short = F.sort_array(F.filter(F.transform(all_lines, trim), lambda x: (x != "") & (F.octet_length(x) < most_bytes)))
        # in order, a line that equals the one so many places on occurs often enough
        return bind(short, lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + times - 1) == x)))

    return bind(lines(text), lambda all_lines: bind(repeated(all_lines), lambda often: kept(all_lines, often)))


def remove_template_lines(text: Column) -> Column:
    """Drops lines of labels whose values are missing: two or more colons followed by nothing but white space and CJK."""
    colon = lambda line: line.contains(":") | line.contains("：")
    return joined(F.filter(lines(text), lambda line: ~(colon(line) & trim(line).rlike(rf"\A[^:：]*(?:[:：][{SPACE}{CJK}&&[^:：]]*){{2,}}\z"))))


def compress_spaces(text: Column) -> Column:
    """One space between words; the indentation stays."""
    indent = lambda line: F.left(line, F.char_length(line) - F.char_length(F.ltrim(line, F.lit(SPACES))))
    even = lambda inner: F.when(inner.contains("  ") | inner.rlike(f"[{NOT_PLAIN}]"), F.regexp_replace(inner, rf"[{SPACE}]+", " ")).otherwise(inner)
    one = lambda line, inner: F.when(inner == "", "").otherwise(F.concat(indent(line), even(inner)))
    return joined(F.transform(lines(text), lambda line: bind(trim(line), lambda inner: one(line, inner))))


def filter_table_rows(text: Column) -> Column:
    empty = lambda line: line.contains("|") & trim(line).rlike(rf"\A\|[|{SPACE}]*\z") & ~line.contains("---")
    return joined(F.filter(lines(text), lambda line: ~empty(line)))


def strip_token_stats(title: Column) -> Column:
    """Drops every ``(n in/m out tokens)`` behind which no other bracket opens, however many there are."""
    stats = r"\((?=[^(]*in/)(?=[^(]*out tokens\))[^()]*\)"
    return trim(F.regexp_replace(title, rf"{stats}(?=[^(]*(?:{stats}[^(]*)*$)", ""))


def _starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def strip_heartbeat(text: Column) -> Column:
    """Drops heartbeat blocks: from a starting line on, until a line that neither continues the block nor is blank.

    Each line becomes a letter (start, more, other); what is dropped are starts and the mores right behind what is dropped.
    """

    def letter(line: Column) -> Column:
        start = _starts(line, HEARTBEAT_START) | (line.startswith("When reading HEARTBEAT.md") & line.contains("workspace"))
        return F.when(start, "s").when((line == "") | _starts(line, HEARTBEAT_MORE), "m").otherwise("o")

    def kept(all_lines: Column) -> Column:
        letters = F.array_join(F.transform(all_lines, lambda x: bind(trim(x), letter)), "")
        marks = F.split(F.regexp_replace(letters, r"s|(?!^)\Gm", "x"), "")
        return bind(marks, lambda m: joined(F.filter(all_lines, lambda _, i: F.get(m, i) != "x")))

    return bind(lines(text), kept)


def clean_knowledge(text: Column, config: CleanConfig = CleanConfig()) -> Column:
    steps = (
        (config.cjk_spacing, fix_cjk_spacing), (config.watermarks, remove_watermarks), (config.template_lines, remove_template_lines), (config.spaces, compress_spaces),
        (config.table_rows, filter_table_rows), (config.trailing_spaces, trim_trailing), (config.zero_width, strip_zero_width), (config.blank_lines, compress_blank_lines),
        (config.adjacent_lines, dedup_adjacent_lines),
    )
    return _through(text, steps)


def clean_memory(text: Column, config: CleanConfig = CleanConfig()) -> Column:
    return _through(text, ((config.trailing_spaces, trim_trailing), (config.zero_width, strip_zero_width), (config.blank_lines, compress_blank_lines)))


def clean_session(text: Column, config: CleanConfig = CleanConfig()) -> Column:
    steps = ((config.heartbeat, strip_heartbeat), (config.adjacent_lines, dedup_adjacent_lines), (config.trailing_spaces, trim_trailing), (config.zero_width, strip_zero_width), (config.blank_lines, compress_blank_lines))
    return _through(text, steps)


def _through(text: Column, steps) -> Column:
    """Steps in order. Each result is bound as a lambda's argument, so that an expression doesn't repeat the ones before it."""
    for wanted, step in steps:
        if wanted:
            text = bind(text, step)
    return text


def is_tiny(text: Column, config: CleanConfig = CleanConfig()) -> Column:
    return F.octet_length(trim(text)) < config.tiny_bytes


def is_empty_session(text: Column, config: CleanConfig = CleanConfig()) -> Column:
    return (F.octet_length(text) <= config.empty_session_bytes) & ~text.rlike(rf"(?m)^[{SPACE}]*(?:{'|'.join(SESSION_SPEAKERS)}):")


def clean_pdf_lines(text: Column) -> Column:
    """Every line trimmed, blank runs collapsed."""
    return trim_trailing(compress_blank_lines(joined(F.transform(lines(text), trim))))


def is_readable(text: Column) -> Column:
    marked = F.lit(False)
    for marker in BINARY_MARKERS:
        marked = marked | text.contains(marker)
    cjk = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"))
    return (text != "") & ~marked & ((cjk > 10) | (F.regexp_count(text, F.lit("[A-Za-z]+")) > 5))


def is_binary_garbage(text: Column) -> Column:
    """More than 30 % special characters, more than five in a row, hardly any printable ones, or more than 20 % rare ones."""
    total = F.char_length(text)
    special = r"[^\x20-\x7E\x{4E00}-\x{9FFF}\x{3000}-\x{303F}]"
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    rare = count(r"[\x{E000}-\x{F8FF}\x{FFF0}-\x{FFFF}\x{2400}-\x{243F}]") + F.when(total < 20, count(r"[\x{2500}-\x{257F}]")).otherwise(0)
    little = (count(r"[\x{4E00}-\x{9FFF}\x{3000}-\x{303F}]") == 0) & (count(r"[\x20-\x7E]") < 5)
    return (text == "") | (count(special) / F.greatest(total, F.lit(1)) > 0.3) | text.rlike(f"{special}{{6}}") | little | (rare / F.greatest(total, F.lit(1)) > 0.2)


def merge_texts(a: Column, b: Column) -> Column:
    """The longer of two texts if more than half of the first one's lines lie in the second, else one after the other."""

    def merged(a: Column, b: Column, own: Column) -> Column:
        shared = F.size(F.filter(own, lambda x: b.contains(x)))  # a line holds no line feed, so it lies within one line of b
        longer = F.when(F.octet_length(b) > F.octet_length(a), b).otherwise(a)
        return F.when(F.size(own) == 0, b).when(trim(b) == "", a).when(shared * 2 > F.size(own), longer).otherwise(F.concat(a, F.lit("\n\n"), b))

    # each is computed once, not for every line
    lines_of = lambda a: F.filter(F.transform(lines(a), trim), lambda x: x != "")
    return bind(a, lambda a: bind(b, lambda b: bind(lines_of(a), lambda own: merged(a, b, own))))
