"""Text cleaning, estimates and predicates as column functions: each takes and returns a Column.

Whitespace is Unicode's, as ``(?U)\\s`` matches it; ``trim`` of the engine would only take spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns that decide what a text becomes.
CJK = r"[\x{3000}-\x{303F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3100}-\x{312F}\x{31F0}-\x{31FF}\x{3200}-\x{33CF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2A6DF}\x{2F800}-\x{2FA1F}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
FOREIGN = r"[\x{250}-\x{36F}\x{370}-\x{4FF}\x{590}-\x{6FF}\x{900}-\x{E7F}\x{F00}-\x{FFF}\x{1100}-\x{1CFF}\x{1D00}-\x{1EFF}\x{2100}-\x{214F}]"
SENTENCE_ENDS = "。！？…!?.\"'》）"
LINE_ENDS = "。！？…》）\"'.!」』】》〕〉"
NUMERALS = "一二三四五六七八九十百千"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
BULLETS = "●·•○◆■□▪▸➢"
MARKS = "★—●·•○◆■□▪▸➢☑✓✔✗✘"
ORDINALS = "一是|二是|三是|四是|五是|六是|七是|八是|九是|十是"
WIDE = (
    r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{30000}-\x{3134F}\x{2F800}-\x{2FA1F}\x{F900}-\x{FAFF}"
    r"\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
)
SUB_HEADING = rf"^(?:[（]\s*[{NUMERALS}\d]+[）]|\d+\s*[.、]|[一二三四五六七八九十]+[、]|★[^★]|\d+[、])"
LIST_ITEM = (
    rf"^(?:[（]\s*\d+[）]|\d+\s*[.、．]|[{CIRCLED}]|[{MARKS}]|——|[一二三四五六七八九十]+[、．]|第[{NUMERALS}\d]+[条款项]|(?:{ORDINALS})|\d{{1,2}}(?=[\x{{4E00}}-\x{{9FFF}}]))"
)
LINE_LIST_ITEM = rf"^(?:\d{{1,3}}\s*[.、．)）](?=\D)|[（(]\s*\d+\s*[）)]|[（(][{NUMERALS}\d]+[）)]|[一二三四五六七八九十]+[、．]|(?:{ORDINALS})|[{CIRCLED}]|[{MARKS}])"
LINE_CHAPTER = rf"^第[{NUMERALS}\d]+[章节条款项部编]"
LINE_START = rf"^(?:\d{{1,3}}\s*[.、．)）]\s*\D|[（(]\s*\d+\s*[）)]|[（(][{NUMERALS}\d]+[）)]|第[{NUMERALS}\d]+[章节条款项部]|[一二三四五六七八九十]、|(?:{ORDINALS})|[{BULLETS}])"
PAGE_NUMBER = r"^\s*[—\-－]+\s*\d+\s*[—\-－]+\s*$"
EMBEDDED_PAGE_NUMBER = r"[—\-－]+\s*\d+\s*[—\-－]+"
PRINT_DATE = r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(f"(?U){pattern}"), F.lit(to))


def strip(c: Column) -> Column:
    return _sub(c, r"^\s+|\s+$", "")


def lstrip(c: Column) -> Column:
    return _sub(c, r"^\s+", "")


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?U){pattern}")


def clean_text(c: Column, foreign: bool = True) -> Column:
    """Repair extracted text: control and stray foreign characters, misplaced percent signs, spacing around CJK.

    foreign=False keeps Greek, Cyrillic, Arabic and the other scripts that are removed otherwise.
    """
    c = F.regexp_replace(c, F.lit(CONTROL), F.lit(""))
    if foreign:
        c = F.regexp_replace(c, F.lit(FOREIGN), F.lit(""))
    rules = [
        (r"(?<!\d)%\s*([^%\d]{1,30}?)(\d+\.?\d*)", "$2%$1"),
        (rf"([\d%])\s+({CJK})", "$1$2"),
        (rf"({CJK})\s+([\d])", "$1$2"),
        (rf"([a-zA-Z])\s+({CJK})", "$1$2"),
        (rf"({CJK})\s+([a-zA-Z])", "$1$2"),
        (rf"\s*,\s*({CJK})", "，$1"),
        (rf"({CJK})\s*,\s*", "$1，"),
        (r"\s+([，。、；：！？》）])", "$1"),
        (rf"([，。、；：！？])\s+({CJK})", "$1$2"),
        (r"[ \t]+", " "),
    ]
    for pattern, to in rules:
        c = _sub(c, pattern, to)
    return strip(c)


def fix_percent_order(c: Column) -> Column:
    """A percent sign that stands before its number goes behind it."""
    return _sub(c, r"([^\d])%([\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]*)(\d+\.?\d*)", "$1$3%$2")


def estimate_tokens(c: Column) -> Column:
    """Wide characters count 1, white space 0, others a quarter; rounded up."""
    narrow = F.regexp_replace(c, F.lit(WIDE), F.lit(""))
    wide = F.length(c) - F.length(narrow)
    return F.ceil(wide + F.length(_sub(narrow, r"[\s\x{1C}-\x{1F}]", "")) / 4).cast("long")


def quarter_tokens(c: Column) -> Column:
    """The same in quarters, not rounded: the quarters of joined texts add up."""
    narrow = F.regexp_replace(c, F.lit(WIDE), F.lit(""))
    return 4 * (F.length(c) - F.length(narrow)).cast("long") + F.length(_sub(narrow, r"[\s\x{1C}-\x{1F}]", ""))


def ends_sentence(c: Column, ends: str = SENTENCE_ENDS) -> Column:
    """Whether the last character that isn't white space ends a sentence; empty text does."""
    last = F.substring(_sub(c, r"\s+$", ""), -1, 1)
    return (last == "") | F.contains(F.lit(ends), last)


def line_ends_sentence(c: Column) -> Column:
    """The same for lines of a page, with closing brackets and without the ASCII question mark."""
    return ends_sentence(c, LINE_ENDS)


def is_sub_heading(c: Column) -> Column:
    t = strip(c)
    return (F.length(t) <= 50) & ~ends_sentence(t) & matches(t, SUB_HEADING)


def is_list_item(c: Column) -> Column:
    return matches(lstrip(c), LIST_ITEM)


def is_line_list_item(c: Column) -> Column:
    t = lstrip(c)
    return ~matches(t, LINE_CHAPTER) & matches(t, LINE_LIST_ITEM)


def starts_paragraph(c: Column) -> Column:
    return matches(lstrip(c), LINE_START)


def is_page_number(c: Column) -> Column:
    return matches(strip(c), PAGE_NUMBER)


def is_end_matter(c: Column) -> Column:
    """A printing date or a secretariat's line of up to 80 characters."""
    t = strip(c)
    return (F.length(t) <= 80) & (matches(t, PRINT_DATE) | F.contains(t, F.lit("秘书处")))


def drop_page_numbers(c: Column) -> Column:
    return strip(_sub(c, EMBEDDED_PAGE_NUMBER, ""))


def contains_keyword(c: Column, keywords: list[str]) -> Column:
    """Whether a text holds a keyword when spaces and tabs of both are taken out."""
    bare = F.translate(c, " \t", "")
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(bare, F.lit(k.replace(" ", "").replace("\t", "")))
    return found


def has_chinese(c: Column) -> Column:
    return c.rlike(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]")


def is_chapter_heading(c: Column) -> Column:
    return matches(lstrip(c), rf"^(?:第[{NUMERALS}\d]+[章节部编]|[一二三四五六七八九十]+、)")


def is_fragment(c: Column) -> Column:
    """Up to two characters that are dashes, the numeral one or digits."""
    t = strip(c)
    return (F.length(t) <= 2) & matches(t, r"^[—\-－一\d]*$")


def title_level(level: Column) -> Column:
    """0 for levels up to 1, 1 for 2, 2 beyond; what isn't a number is 1."""
    n = F.try_to_number(strip(level), F.lit("S999999999")).cast("int")
    return F.when(n.isNull(), 1).when(n <= 1, 0).when(n == 2, 1).otherwise(2)


def xml_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, F.lit(CONTROL), F.lit("")))


def canonical_name(c: Column) -> Column:
    return F.upper(strip(c))


def format_size(n: Column) -> Column:
    """Bytes, or KB or MB with one digit; halves go to the even digit."""
    part = lambda unit, name: F.format_string(f"%.1f{name}", F.bround(n / unit, 1))
    return F.when(n < 1024, F.format_string("%dB", n)).when(n < 1024 * 1024, part(1024, "KB")).otherwise(part(1024 * 1024, "MB"))


def format_time(seconds: Column) -> Column:
    whole = F.floor(seconds / 60).cast("long")
    return F.when(seconds < 1, F.format_string("%.0fms", seconds * 1000)).when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%dm%ds", whole, (seconds - whole * 60).cast("long")))
