"""Scalar rules on text, names, paths and numbers, as Spark columns that stay in generated code."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the text rules take it, and the Han block.
WS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
HAN = r"\x{4e00}-\x{9fff}"
WORD = r"\p{L}\p{N}_"
#: A Latin token, and phrases by which a question asks for figures.
TOKEN = r"([A-Za-z0-9][A-Za-z0-9._:/-]*)"
FIGURE_TERMS = ("市场规模", "收入", "增速", "毛利", "净利", "成本", "价格", "对比", "统计", "金额", "占比", "cagr")
#: Phrases of image descriptions that say nothing.
EMPTY_PHRASES = ("这张图片是空白的", "这张图片是纯白色的", "没有包含任何文字内容", "没有包含任何可见的文字内容", "没有任何可见的文字内容", "图中没有文字内容", "图中没有可见的文字内容", "图片中未检测到文字")
#: How a text, and how a file's name, tells its page.
TEXT_PAGES = (r"(?:Slide|slide)\s*(\d+)", r"(?:Page|page)\s*(\d+)", r"第\s*(\d+)\s*页")
NAME_PAGES = (r"(?i)_p(\d+)_", r"(?i)(?:slide|page|页|p)(\d+)", r"_(\d{1,4})\.")
#: Fixed value: a passage that points to a figure or table.
REFERENCE_SIGNAL = r"(如下图|如下表|见下图|见下表|图\s*\d+|表\s*\d+)"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; no built-in has it."""
    return text.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^[{WS}]+|[{WS}]+$", "")


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")


def search_text(c: Column, fold: bool = True) -> Column:
    """Text as the index takes it: compatibility form, one kind of line end, stripped."""
    return strip(unix_lines(nfkc(c) if fold else c))


def paragraph_text(c: Column) -> Column:
    """At most one empty line between paragraphs."""
    return strip(F.regexp_replace(unix_lines(c), r"\n{3,}", "\n\n"))


def spaced_text(c: Column) -> Column:
    """As :func:`paragraph_text`, with runs of spaces and tabs as one space."""
    return strip(F.regexp_replace(F.regexp_replace(unix_lines(c), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def trimmed_lines(c: Column) -> Column:
    return strip(F.regexp_replace(unix_lines(c), f"[{WS}&&[^\n]]+(?=\n|$)", ""))


def one_line(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{WS}]+", " "))


def name_token(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{WS}]+", ""))


def key_part(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[{WS}_\-.]+", ""))


def slug(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(strip(c), f"[^{WORD}{HAN}-]+", "_"), "^_+|_+$", "")
    return F.when(text == "", "document").otherwise(text)


def without_controls(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", "")


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 1)


def sparse_tokens(c: Column, fold: bool = True) -> Column:
    """Latin tokens, then each Han run with its pairs and triples; repeats stay."""
    text = F.lower(search_text(c, fold))
    grams = lambda r, k: F.when(F.length(r) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - (k - 1), F.lit(1))), lambda i: r.substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"([{HAN}]+)"), 1), lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(F.array(r), grams(r, 2), grams(r, 3))))
    return F.concat(latin_tokens(text), F.flatten(runs))


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(strip(c), pattern), strip), lambda x: x != "")


def keywords_by_space(c: Column) -> Column:
    return _parts(c, f"[、,，;；{WS}]+")


def keywords_by_mark(c: Column) -> Column:
    return _parts(c, r"[、,，;；|\n]+")


def clean_keywords(c: Column, most: int = 6) -> Column:
    """A keyword list cleaned of bullets, numbers and closing marks, distinct, cut, joined."""
    cleaned = F.transform(keywords_by_mark(c), lambda x: F.regexp_replace(strip(F.regexp_replace(x, rf"^[\-•\d.{WS}]+", "")), "^[。；;，,：:]+|[。；;，,：:]+$", ""))
    joined = F.array_join(F.slice(F.array_distinct(F.filter(cleaned, lambda x: F.length(x) > 1)), 1, most), "、")
    return F.when(c.startswith("ERROR"), c).otherwise(joined)


def file_kind(c: Column) -> Column:
    t = name_token(c)
    return F.when(t.startswith("ppt"), "pptx").when(t.startswith("doc") | (t == "word"), "docx").when(t.startswith("xls"), "xlsx").when(t.startswith("pdf"), "pdf").otherwise(t)


def suffix_of_kind(c: Column) -> Column:
    """The file suffix that a kind, in whatever words, names somewhere."""
    t = name_token(c)
    return F.when(t.contains("pptx"), ".pptx").when(t.contains("ppt"), ".ppt").when(t.contains("docx"), ".docx").when(t.contains("doc") | t.contains("word"), ".doc").when(t.contains("pdf"), ".pdf").otherwise("")


def directory_key(c: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(strip(c), r"\\", "/"), "/"), lambda p: (p != "") & (p != "source_data"))
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def first_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.regexp_extract(strip(c), r"(\d+)", 1).try_cast("bigint"), F.lit(default).cast("bigint"))


def base_name(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(strip(c), r"\\", "/"), r"([^/]*)$", 1)


def stem(c: Column) -> Column:
    return F.regexp_replace(base_name(c), r"(?i)\.(png|jpe?g|gif|bmp|webp|md|pdf|docx?|pptx?|xlsx?)$", "")


def label(c: Column) -> Column:
    """A file name for matching: no suffix, lower, numbers without leading zeros, no separators."""
    parts = F.regexp_extract_all(F.lower(stem(c)), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.regexp_replace(p, r"^0+(?=\d)", "")).otherwise(F.regexp_replace(p, rf"[{WS}_\-.]+", ""))), "")


def numbers_of(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(stem(c), F.lit(r"(\d+)"), 1), lambda p: p.cast("bigint"))


def _ordered(digits: Column) -> Column:
    """Digits in an order that is that of their values: their number goes before them."""
    return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)


def natural_key(c: Column) -> Column:
    """Sort key that orders numbers inside names by value."""
    parts = F.regexp_extract_all(F.lower(base_name(c)), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), _ordered(F.regexp_replace(p, r"^0+(?=\d)", "")))).otherwise(F.concat(F.lit("1"), p))), "\x01")


def _first_number(c: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns)).try_cast("int")


def page_hint(c: Column) -> Column:
    """The page that a text says it is of."""
    return _first_number(F.coalesce(c, F.lit("")), TEXT_PAGES)


def path_page_hint(c: Column) -> Column:
    """The page that a file's name tells."""
    return _first_number(base_name(c), NAME_PAGES)


def web_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.url_encode(F.coalesce(c, F.lit(""))), r"\+", "%20"), "%2F", "/")


def media_path(c: Column, roots: tuple[str, ...]) -> Column:
    """A path from one of the folders media may come from: as it stands, below the first of them if it only begins with
    ``assets/``, from the folder's name on if it stands deeper; any other path gives nothing."""
    path = F.regexp_replace(F.regexp_replace(strip(c), r"\\", "/"), r"^[./]+", "")
    lower = F.lower(path)
    out = F.when(path == "", "")
    for r in roots:
        out = out.when(lower.startswith(r.lower()), F.concat(F.lit(r), F.substring(path, len(r) + 1, 1 << 20)))
    out = out.when(lower.startswith("assets/"), F.concat(F.lit(roots[0]), path))
    for r in roots:
        at = F.instr(lower, r.lower())
        out = out.when(at > 0, path.substr(at, F.length(path)))
    return out.otherwise("")


def safe_path(c: Column, roots: tuple[str, ...]) -> Column:
    """Whether a path is relative, never climbs, and lies under one of the roots."""
    under = F.lit(False)
    for r in roots:
        under = under | c.startswith(r)
    return F.coalesce(~c.rlike(r"^([/\\]|[A-Za-z]:)") & ~c.rlike(r"(^|/)\.\.(/|$)") & under, F.lit(False))


def low_quality(c: Column, ratio: float = 0.2) -> Column:
    t = strip(c)
    han, digits = F.length(F.regexp_replace(t, f"[^{HAN}]", "")), F.length(F.regexp_replace(t, r"[^\p{Nd}]", ""))
    return (t == "") | ((han == 0) & (digits > 5)) | ((digits / (F.length(t) + 1) > ratio) & (han < 5))


def low_signal(c: Column) -> Column:
    t = strip(c)
    return (t == "") | t.rlike("|".join(EMPTY_PHRASES))


def figure_bias(c: Column) -> Column:
    return F.when(F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(FIGURE_TERMS)), 0.15).otherwise(0.0)


def preview(c: Column, most: int = 220) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def overlap(left: Column, right: Column) -> Column:
    """Shared distinct keywords over the smaller set."""
    a, b = F.array_distinct(F.coalesce(left, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(right, F.array().cast("array<string>")))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))
