"""Text functions as Column expressions: tokens, normal forms, cleaning, splitting, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CJK = "\\u4e00-\\u9fff"
EDGE = r"^[\s 　]+|[\s 　]+$"
TERMINATORS = "。！？!?；;"
STOP_WORDS = ("about", "after", "their", "there", "these", "those", "which", "while", "would", "should", "could")
SECTION_SEPARATOR = " / "


def strip(c: Column) -> Column:
    """Without white space at either end; trim() would take blanks only."""
    return F.regexp_replace(c, EDGE, "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def terms(c: Column) -> Column:
    """Lower-cased ASCII words whole, runs of CJK characters as bigrams; everything else separates."""
    runs = F.regexp_extract_all(c, F.lit(f"([{CJK}]+|[a-zA-Z0-9_]+)"), F.lit(1))
    bigrams = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))
    own = lambda r: F.when(r.rlike("^[a-zA-Z0-9_]"), F.array(F.lower(r))).when(F.length(r) == 1, F.array(r)).otherwise(bigrams(r))
    return F.flatten(F.transform(runs, own))


def squeeze(c: Column) -> Column:
    """Without any white space, lower-cased: the form in which audits compare texts."""
    return F.lower(F.regexp_replace(c, r"[\s 　]+", ""))


def collapse_blanks(c: Column) -> Column:
    """Runs of blanks as one, carriage returns dropped, ends trimmed; new lines stay."""
    return strip(F.regexp_replace(F.regexp_replace(c, "\r", ""), r"[ \t 　]+", " "))


def clean_page(c: Column, header: str = "") -> Column:
    """A page's text without header and page-number lines, with at most one blank line in a row."""
    number = rf"^\s*(\d{{1,4}}|第\s*\d+\s*页|\d+\s*/\s*\d+)\s*$"
    keep = lambda line: ~line.rlike(number) & ((strip(line) != header) | F.lit(header == ""))
    lines = F.filter(F.split(c, "\n", -1), keep)
    text = F.array_join(lines, "\n")
    return strip(F.regexp_replace(text, r"\n[ \t]*(\n[ \t]*)+\n", "\n\n"))


def sentences(c: Column) -> Column:
    """Sentences: cut after a terminator (and a closing quote) or a new line; the text itself if none."""
    marked = F.regexp_replace(c, f"([{TERMINATORS}][”’\"')）」』]?|\n)\\s*", "$1\u001f")
    parts = F.filter(F.transform(F.split(marked, "\u001f", -1), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def atomic_segments(c: Column) -> Column:
    """Array of (text, atomic): fenced code, pipe tables and images in one piece, the rest between."""
    pattern = r"(```[\s\S]*?```|(?:^|(?<=\n))\|[^\n]*\|(?:\n\|[^\n]*\|)+|!\[[^\]]*\]\([^)]*\))"
    inside = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    outside = F.split(c, pattern, -1)
    pieces = F.zip_with(outside, inside, lambda o, i: F.array(F.struct(o.alias("text"), F.lit(False).alias("atomic")), F.struct(i.alias("text"), F.lit(True).alias("atomic"))))
    return F.filter(F.flatten(pieces), lambda s: s["text"].isNotNull() & (s["text"] != ""))


def identifiers(c: Column, least: int = 5, most: int = 3) -> Column:
    """Up to ``most`` distinct lower-cased identifiers, the longest first, ties by name."""
    found = F.transform(F.regexp_extract_all(c, F.lit(rf"[A-Za-z_][A-Za-z0-9_]{{{least - 1},}}"), F.lit(0)), F.lower)
    found = F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))
    ordered = F.array_sort(F.transform(found, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(F.slice(ordered, 1, most), lambda s: s["t"])


def heading_level(title: Column) -> Column:
    """1 for a part, 2 for a chapter, 3 to 5 by the depth of the leading number; else null."""
    return (
        F.when(title.rlike(r"^\s*PART\b"), 1).when(title.rlike(r"^\s*第\s*[0-9一二三四五六七八九十]+\s*章"), 2)
        .when(title.rlike(r"^\s*\d+(\.\d+){3}"), 5).when(title.rlike(r"^\s*\d+(\.\d+){2}"), 4).when(title.rlike(r"^\s*\d+\.\d+"), 3)
    )


def section_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)*)", 1), F.lit(""))


def section_path(*parts: Column) -> Column:
    return F.concat_ws(SECTION_SEPARATOR, *[F.nullif(p, F.lit("")) for p in parts])


def last_segment(path: Column) -> Column:
    """Last part of a path that isn't blank."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda s: strip(s) != ""), F.lit(-1))


def slug(c: Column, most: int = 40) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), rf"(?U)[^\w{CJK}]+", "_"), "^_+|_+$", "").substr(1, most)


def api_name(c: Column) -> Column:
    """Last identifier of a prototype."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"[A-Za-z_]\w*"), F.lit(0)), F.lit(-1))


def error_code(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\bE\d{3,5}\b", 0), F.lit(""))


def source_url(base: Column, name: Column) -> Column:
    quoted = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    trimmed = F.regexp_replace(F.coalesce(base, F.lit("")), "/+$", "")
    return F.when(trimmed == "", quoted).otherwise(F.concat(trimmed, F.lit("/"), quoted))


def content_type(file_name: Column) -> Column:
    """Kind of a document by the stem of its file name."""
    stem = F.regexp_replace(F.lower(file_name), r"\.[^.]*$", "")
    return (
        F.when(stem == "faq", "faq").when(stem.endswith("-example"), "tutorial").when(stem.contains("log_info"), "error")
        .when(stem.rlike("^(group_|struct_|class_|functions_|dir_|namespace)"), "api").otherwise("guide")
    )


def printed_page(text: Column) -> Column:
    """First of the first four lines that is a number of up to four digits."""
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 4), strip), lambda x: x.rlike(r"^\d{1,4}$"))
    return F.try_element_at(lines, F.lit(1)).cast("int")


def page_int(c: Column) -> Column:
    """A page as int from strings such as ' 12 ', '12.0' or 'None'."""
    return F.expr(f"try_cast(try_cast(nullif(lower(trim({c._jc.toString()})), 'none') AS double) AS int)")


def collection_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_")


def preview(c: Column, n: int = 120) -> Column:
    return F.translate(c.substr(1, n), "\n", "⏎")


def citation(rank: Column, kind: Column, source: Column, section: Column, page: Column) -> Column:
    """Source line of one hit in an answer's context."""
    where = F.concat_ws("，", F.nullif(section, F.lit("")), F.when(page.isNotNull(), F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"))))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] 来源："), F.upper(F.coalesce(kind, F.lit(""))), F.lit(" "), source, F.lit(" "), where)


def sse_frame(event: Column, payload: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), payload, F.lit("\n\n"))


def abstains(answer: Column) -> Column:
    """Whether an answer says that there is no evidence; blank answers do not."""
    # Fixed values.
    markers = (
        "无法回答", "没有找到", "未找到", "没有相关", "无相关", "资料中没有", "文档中没有", "不在文档范围", "无法确定",
        "cannot answer", "not found", "no evidence", "don't know",
    )
    said = F.lower(answer)
    any_of = F.lit(False)
    for m in markers:
        any_of = any_of | said.contains(m)
    return F.coalesce(~is_blank(answer) & any_of, F.lit(False))
