"""Footers, page chrome, consent walls and broken copies in texts, as Column expressions. Nulls give null."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, written with the blanks and word bounds of ECMAScript (see ``pattern``).
BOILERPLATE_LINE = r"(?i)^\s*(?:【?(?:版权|免责|声明|免责声明)】?|(?:国家|本站)?[^\n]{0,24}版权所有|Copyright\b|©\s*\d{4}|.*未经授权(?:禁止|不得).+|凡本网注明.*|转载请注明出处|ICP备\d+[^\n]{0,12}号|违法和不良信息举报电话[^\n]*|网站简介|联系我们|关于我们|技术支持[：:][^\n]*|主办[：:][^\n]*|承办[：:][^\n]*|All rights reserved)\b.*$"
BOILERPLATE_SEGMENT = r"(?i)[^。；;\n]{0,40}版权所有[^。；;\n]{0,120}|Copyright[^。；;\n]{0,120}|未经授权(?:禁止|不得)[^。；;\n]{0,60}|凡本网注明[^。；;\n]{0,120}|转载请注明出处|ICP[备证]\d+[^\n]{0,16}号|违法和不良信息举报电话[^\n]{0,24}|All rights reserved|【?免责声明】?[^\n]{0,60}|技术支持[：:][^\n]{0,40}"
LINE_SIGN = "(?i)版权|免责|声明|Copyright|©|未经授权|凡本网注明|转载请注明出处|ICP备|违法和不良信息|网站简介|联系我们|关于我们|技术支持|主办|承办|All rights reserved"
SEGMENT_SIGN = "(?i)版权所有|Copyright|未经授权|凡本网注明|转载请注明出处|ICP[备证]|违法和不良信息举报电话|All rights reserved|免责声明|技术支持"
CHROME_SIGN = "【|[大小]字体|责任编辑"
CHROME_SEGMENT = r"【(?:编辑|责编|排版|校对)[：:][^】]{1,20}】|(?<!\S)大字体\s*小字体(?!\S)|(?<!\S)[大小]字体(?!\S)|责任编辑[：:]\s?[^\s，。；、：]{1,8}(?!\S)"
CHROME_LEAD = r"^\d{4}年\d{1,2}月\d{1,2}日\s*\d{1,2}[:：]\d{2}(?:[:：]\d{2})?\s*来源[：:]\s*(?:[^\s，。；、：]{1,16}(?=[\s　])|\s*$)\s*"
CHROME_TAIL = r"[（(]\s*(?:完|全文完)\s*[)）]\s*$"
PLACEHOLDER = r"\{\{[^{}]{1,160}\}\}"
PLACEHOLDER_TAIL = r"\s*\{\{(?:javascript:|article\.|journal\.|window\.|custom_)[^{}]{0,160}$"
PDF_MARK = r"(?i)(?<!\S)PDF\(\d+(?:[.,]\d+)? ?[KMGT]?B\)(?!\S)"
READER_CHROME = r"(?<!\S)\d{4}[-年]\d{1,2}[-月]\d{1,2}日?\s*\d{1,2}[:：]\d{2}(?:[:：]\d{2})?\s*[|｜]\s*字号[：:][^|｜\n]{0,30}|(?<!\S)[|｜]\s*(?:打印|关闭|分享|收藏|字体)\s*[|｜]?(?!\S)|(?<!\S)[大中小]\s*(?=[|｜])|(?<!\S)Aa\s*(?=[|｜\s])"
READER_TRACES = r"(?:^|\s)Aa\s*[/|｜]\s*字体[：:]|(?:^|\s)字体[：:][\s【]*[小中大][\s】]*[\s】]*[中][\s】]*[小中大]|(?:^|\s)字号[：:][\s【]*[大中小][\s】]*[\s】]*[中][\s】]*[大中小]|\d{4}[-年]\d{1,2}[-月]\d{1,2}日?\s*\d{1,2}[:：]\d{2}\s*[|｜]\s*(?:字号|字体)[：:]"
CONSENT_WALL = r"(?i)(?:我们|本站|本网站|This\s+site|We)\s*(?:使用|utilize|use)\s*(?:了\s*)?Cookie[^\n]{0,400}(?:我同意|同意并继续|继续浏览即表示您同意|Accept|I\s+Agree|Accept\s+All|同意\s*$)"
CONSENT_HEAD = 600
BOILERPLATE_SQL = "版权所有|Copyright|未经授权禁止|凡本网注明|ICP[备证]|违法和不良信息举报|免责声明|转载请注明出处|技术支持[：:]|All rights reserved"
CHROME_SQL = "大字体|【(?:编辑|责编|排版|校对)[：:]|责任编辑[：:]|[（(]完[)）]$"
SOURCE_LINE_SQL = "^[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日[^。]{0,20}来源[：:]"
TRAILING_CHROME = (
    r"^topics$", r"^tags?$", r"^latest in [\p{L}\s&-]{1,30}$", r"^latest (?:news|stories)$", r"^most (?:popular|read)$", r"^related (?:articles|posts|stories|content|reading|coverage)$",
    r"^more (?:stories|articles|news)$", r"^(?:keep reading|read next|up next)$", r"^(?:you (?:might|may) also like|recommended(?: for you)?)$", r"^(?:subscribe|sign up)\b.{0,80}$",
    r"^share (?:this|on)\b.{0,40}$", r"^follow us\b.{0,40}$", r"^advertisement$",
)
SENTENCE_END = "[.。!！?？:：]$"
DEFECTS = (
    ("�", "replacement-character"), ("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "control-character"), ("⟦G\\d+⟧", "unrestored-protected-token"), ("(\\p{L})\\1{24,}", "repeated-character"),
    ("(?s)(?:\\\\u[0-9a-fA-F]{4}.*?){4}", "literal-unicode-escapes"),
)
SUMMARY_MOST, SUMMARY_ENOUGH, SUMMARY_LEAST, CLAUSE_LEAST = 190, 80, 50, 30
NAME_LIST_LEAST, COPIES_OF_CHROME = 40, 3
SCIENCE_HOST = r"(?i)^https?://(?:[^/?#]*\.)?copernicus\.org(?:[:/?#]|$)|^https?://doi\.org/10\.5194/"
CITATION = r"^[\p{Lu}][\p{L}'’.-]+,\s*(?:[A-Z]\.\s*){1,5}"
NARRATIVE = r"(?is)<h[2-5]\b[^>]*>(?:(?!</h[2-5]>).)*(?:Abstract|Introduction|Method|Result|Discussion|Conclusion)"
#: End of fixed values.

_BLANKS = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_BOUND = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def pattern(text: str) -> str:
    r"""A pattern for Java: \s takes all blanks, \S none of them, \b looks at ASCII words only."""
    out, in_class = [], False
    for token in re.findall(r"\\.|[^\\]", text, re.S):
        if token == r"\s":
            token = _BLANKS if in_class else f"[{_BLANKS}]"
        elif token == r"\S":
            token = f"[^{_BLANKS}]"
        elif token == r"\b":
            token = _BOUND
        elif token in "[]":
            in_class = token == "["
        out.append(token)
    return "".join(out)


def has(text: Column, expression: str) -> Column:
    return text.rlike(pattern(expression))


def cut(text: Column, expression: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern(expression), by)


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is looked at."""
    return F.transform(F.array(value), use)[0]


def cut_where(text: Column, sign: str, expression: str, by: str = " ") -> Column:
    """``cut`` in texts that have a sign without which the expression can't match; others pass untouched."""
    return once(text, lambda t: F.when(t.rlike(sign), cut(t, expression, by)).otherwise(t))


def strip_boilerplate(text: Column, lined: bool = True) -> Column:
    """Without footers (whole lines, then segments), the chrome of news pages, placeholders and marks of downloads. lined: are the text's lines those
    of the page? Of a text put into one line a footer takes its segment only, not all that follows it."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: (x != "") & ~(x.rlike(LINE_SIGN) & has(x, BOILERPLATE_LINE)) if lined else x != "")
    # these segments end with their line, so only lines that have a sign of one are looked through
    out = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(SEGMENT_SIGN), cut(x, BOILERPLATE_SEGMENT, " ")).otherwise(x)), "\n")
    for sign, segment in ((CHROME_SIGN, CHROME_SEGMENT), ("\\{\\{", PLACEHOLDER), ("(?i)PDF\\(", PDF_MARK)):
        out = cut_where(out, sign, segment)
    out = cut_where(cut(out, CHROME_LEAD), "完", CHROME_TAIL, "")
    return trimmed(cut(cut(out, r"\n{3,}", "\n\n"), "[ \t]{2,}", " "))


def strip_truncated_tail(text: Column) -> Column:
    """Without a placeholder of a page's script that the end of the text cuts off."""
    return trimmed(cut(text, PLACEHOLDER_TAIL))


def strip_reader_chrome(text: Column) -> Column:
    """Without the buttons of reading tools; times and sizes inside sentences stay."""
    return trimmed(cut(cut(cut_where(text, "[|｜]|Aa", READER_CHROME), "[|｜]{2,}", " | "), "[ \t]{2,}", " "))


def strip_consent_wall(text: Column) -> Column:
    """Without a consent wall in the first characters; these go as a whole if the wall is nearly all there is."""

    def without(t: Column) -> Column:
        head, rest = F.substring(t, 1, CONSENT_HEAD), F.substring(t, CONSENT_HEAD + 1, 1 << 30)
        left = trimmed(cut_where(head, "(?i)cookie", CONSENT_WALL, ""))
        return once(left, lambda x: F.when((F.char_length(x) < 20) & (F.char_length(head) > 200), trimmed(rest)).otherwise(F.concat(x, rest)))

    return once(text, without)


def boilerplate_hint(text: Column) -> Column:
    """May a text have boilerplate? A cheap test that misses some and names none that has none."""
    return text.rlike(BOILERPLATE_SQL) | text.rlike(CHROME_SQL) | text.rlike(SOURCE_LINE_SQL)


def template_shell(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PLACEHOLDER)) >= 3


def boilerplate_body(text: Column, least: int = 60, lined: bool = True) -> Column:
    """Is there no real text: none at all, a template's shell, or too little beside boilerplate?"""
    real = F.char_length(cut(strip_boilerplate(text, lined), r"\s+"))
    return F.coalesce((text == "") | template_shell(text) | (real < least), F.lit(True))


def copy_defect(text: Column) -> Column:
    """Why a translated text is broken, by its first defect; null for none."""
    return F.coalesce(*[F.when(text.rlike(p), name) for p, name in DEFECTS])


def model_text(text: Column) -> Column:
    """Plain text for a model: without boilerplate, tags and addresses, entities decoded."""
    out = strip_boilerplate(text)
    for p in (r"(?is)<(script|style)[^>]*>.*?</\1>", "<[^>]+>", "(?i)https?://[^\\s]+", "(?i)&nbsp;"):
        out = cut(out, p, " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.regexp_replace(out, "(?i)" + entity, char)
    out = cut(cut(cut(out, "[ \t]+", " "), "[ \t]*\n[ \t]*", "\n"), "\n{3,}", "\n\n")
    return trimmed(out)


def announces_list(tail: Column) -> Column:
    """Does the end of a text begin an enumeration: a colon at its end, or a numbered item?"""
    return has(tail, r"[：:]$") | has(tail, r"(?:^|[\s。；;，、(（])[0-9０-９]{1,2}(?:[、)]|\.(?:[^0-9％%]|$))")


def close_sentence(text: Column) -> Column:
    """A summary that ends with a whole sentence: a separator at the end becomes a stop (an ellipsis in a list), else the text is
    cut after its last sentence, else after its last clause if that is long enough."""
    return once(trimmed(text), _closed)


def _closed(t: Column) -> Column:
    # the end is looked at by itself: a pattern that is bound to it would be tried at every place of the text
    end = F.substring(t, -2, 2)
    clause = F.regexp_extract(t, r"(?s)^(.*)[，、；：,;:]", 1)
    return (
        F.when((t == "") | has(end, "[。！？…!?][”』」'\")）]?\\z"), t)
        .when(has(end, r"[，、；：,;:]\z"), once(F.rtrim(t, F.lit("，、；：,;:" + BLANKS)), lambda bare: F.concat(bare, F.when(has(end, r"[：:]\z") | announces_list(_after_stops(bare)), "……").otherwise("。"))))
        .when(has(t, "[。！？…]"), F.regexp_extract(t, r"(?s)^(.*[。！？…])", 1))
        .otherwise(F.concat(once(clause, lambda c: F.when(F.char_length(c) >= CLAUSE_LEAST, c).otherwise(t)), F.lit("。")))
    )


def _after_stops(text: Column) -> Column:
    """What follows the last stop."""
    return reduce(lambda rest, stop: F.substring_index(rest, stop, -1), "。！？…", text)


def _packed(parts: Column, spare: int) -> Column:
    """The first parts, until they are enough and as long as they fit."""
    empty = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(state: Column, part: Column) -> Column:
        longer = F.concat(state["text"], part)
        stop = state["full"] | (F.char_length(longer) + spare > SUMMARY_MOST) | (F.char_length(state["text"]) >= SUMMARY_ENOUGH)
        return F.struct(F.when(stop, state["text"]).otherwise(longer).alias("text"), stop.alias("full"))

    # a part has a character at least, so no later one fits
    return F.aggregate(F.slice(parts, 1, SUMMARY_MOST + 1), empty, step)["text"]


def compact_summary(text: Column) -> Column:
    """A summary of at most 190 characters: whole sentences, else whole clauses, else the text as it is."""
    lines = F.filter(F.transform(F.split(trimmed(text), "\n"), trimmed), lambda x: x != "")
    return once(F.array_join(lines, " "), _compact)


def _compact(t: Column) -> Column:
    def parts(ends: str) -> Column:
        # a part goes on to the next end; beyond so many characters that are no ends no part fits, whatever it holds
        start = F.regexp_extract(t, f"^(?:[{ends}]*+[^{ends}]){{0,{SUMMARY_MOST + 1}}}[{ends}]*+", 0)
        return F.regexp_extract_all(start, F.lit(f"[^{ends}]+[{ends}]?"), F.lit(0))

    sentences, clauses = _packed(parts("。！？!?"), 0), _packed(parts("，；：、,;:"), 1)
    of_clauses = once(clauses, lambda c: F.when(F.char_length(c) >= SUMMARY_LEAST, F.concat(F.regexp_replace(c, "[，；：、,;:]$", ""), F.lit("。"))).otherwise(t))
    of_sentences = once(sentences, lambda s: F.when(F.char_length(s) >= SUMMARY_LEAST, trimmed(s)).otherwise(of_clauses))
    return F.when(F.char_length(t) <= SUMMARY_MOST, close_sentence(t)).otherwise(of_sentences)


def name_list(text: Column) -> Column:
    """A long run with commas that never ends a sentence."""
    return (F.char_length(text) >= NAME_LIST_LEAST) & F.contains(text, F.lit(",")) & ~text.rlike("[.。!?！？]$")


def trailing_chrome(text: Column) -> Column:
    ends = reduce(lambda a, b: a | b, [has(text, "(?i)" + p) for p in TRAILING_CHROME])
    return ends & ~text.rlike(SENTENCE_END)


def trim_blocks(blocks: Column) -> Column:
    """Blocks (structs with text and media) without calls to action at the end; the first block stays."""
    kept = F.transform(F.reverse(blocks), lambda b: ~(trailing_chrome(b["text"]) & ~b["media"]))
    last = F.when(F.exists(kept, lambda k: k), F.size(blocks) - F.array_position(kept, True) + 1).otherwise(1)
    return F.slice(blocks, 1, F.greatest(last.cast("int"), F.lit(1)))


def single_figures(html: Column) -> Column:
    """A figure that directly repeats the one before it goes, with the blanks between."""
    return F.regexp_replace(html, pattern(r"(?s)(<figure\b[^>]*>(?:(?!</figure>).)*</figure>)(?:\s*\1)+"), "$1")


def page_published(html: Column) -> Column:
    """The text of a page's time of publishing: its meta element, else its JSON-LD, else its first time element."""
    quoted = r"""["']([^"']*)["']"""
    meta = F.regexp_extract(html, r"""(?i)<meta\b[^>]*\b(?:property=["']article:published_time["']|name=["']pubdate["']|itemprop=["']datePublished["'])[^>]*>""", 0)
    found = (F.regexp_extract(meta, rf"(?i)\bcontent={quoted}", 1), F.regexp_extract(html, r'"datePublished"\s*:\s*"([^"]+)"', 1), F.regexp_extract(html, rf"(?i)<time\b[^>]*\bdatetime={quoted}", 1))
    return F.coalesce(*[F.when(x != "", x) for x in found])


def feed_links(html: Column) -> Column:
    """Addresses of a page's feeds as they are written: links of the kind alternate whose type is a feed's, each once."""
    value = lambda tag, name: F.regexp_extract(tag, rf"""(?i)[\s"']{name}\s*=\s*["']?([^"'>]*)""", 1)
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    feeds = F.filter(tags, lambda t: F.array_contains(F.split(F.lower(value(t, "rel")), r"\s+"), "alternate") & value(t, "type").rlike(r"(?i)^application/(rss|atom|rdf)\+xml$"))
    hrefs = F.transform(feeds, lambda t: F.trim(F.replace(value(t, "href"), F.lit("&amp;"), F.lit("&"))))
    return F.array_distinct(F.filter(hrefs, lambda h: h != ""))
