"""Text rules as Column expressions: cleaning, language by script, quality verdicts, tags, tokens of configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cleaning

# Patterns and word lists that results depend on.
CJK = "[\\u4e00-\\u9fff]"
CJK_WIDE = "[\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff]"
LATIN = "[A-Za-z\\u00c0-\\u024f]"
LABEL_ONLY = "^\\*{0,2}(?:title_zh|summary_zh|body_zh)\\*{0,2}\\s*[:：]\\s*$"
DEICTIC = "本周|本月|今日|今天|昨天|上周|上月|今年|这一年"
CONSENT = "(?i)我同意|同意并继续|继续浏览即表示您同意|Accept\\s+All|I\\s+Agree|允许所有"
TEASERS = ("(?i)\\bappeared first on\\b", "(?i)\\bread (?:the )?full (?:story|article)\\b", "(?i)\\bcontinue reading\\b", "(?i)\\bread more\\b", "…\\s*$", "\\[\\s*(?:…|\\.\\.\\.)\\s*\\]\\s*$")
TEASER_BELOW = 1200
ATTRIBUTION = "(?i)(?:…|\\.{3})\\s*This article was originally published on Mongabay\\.?\\s*$"
FEED_TEASER = "(?i)(?:…|\\.{3})\\s*(?:This article was originally published on Mongabay|本文原发表于\\s*Mongabay)[.。\\s]*$"
TEASER_HOST = "(?i)^https?://(?:[^/?#]*\\.)?mongabay\\.com(?:[:/?#]|$)"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
STRUCTURED = (
    "\\d{1,2}月\\d{1,2}日|\\d{1,2}[:：]\\d{2}|(?i)\\b(?:UTC|GMT|JST|EST|HKT|CST)\\b",
    "(?i)\\d+(?:\\.\\d+)?\\s*(?:级|Magnitude|mb|M\\s?\\d)",
    "(?i)正式测定|本报讯|消息|公告|通报|快讯|Advisory|Hurricane|Storm|Rainfall|Warning|Bulletin|KNHC|NHC",
)
PLACE, WEATHER = "(?:省|市|县|州|岛|海|湾|洋|山|河)", "(?:震|雨|风|潮|洪|雪|雾|涝|旱|灾)"
#: End of fixed values.


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def truncate(text: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(0, most - len(mark)))), F.lit(mark)))


def strip_tags(html: Column) -> Column:
    out = F.regexp_replace(html, "(?is)<(script|style|noscript).*?</\\1>", " ")
    out = F.regexp_replace(out, "(?i)<br\\s*/?>|</(?:p|div|li|h[1-6]|blockquote|pre|tr)>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def escape_xml(text: Column) -> Column:
    out = text
    for char, entity in ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return F.regexp_replace(out, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def has_chinese(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def label_only(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(LABEL_ONLY), F.lit(False))


def body_is_chinese(language: Column, body: Column) -> Column:
    return language.eqNullSafe(F.lit("zh")) | (has_chinese(F.substring(body, 1, 400)) & ~language.eqNullSafe(F.lit("en")))


def infer_language(title: Column, body: Column, sample: int = 2000) -> Column:
    """zh or en by the share of letters of either script; null where that does not tell."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, sample))
    cjk, latin = count_of(text, CJK_WIDE), count_of(text, LATIN)
    share = cjk / F.nullif(cjk + latin, F.lit(0))
    return F.when(cjk + latin < 12, None).when(share >= 0.5, "zh").when((share <= 0.02) & (latin >= 25), "en")


def is_teaser(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(ATTRIBUTION) | ((F.char_length(t) < TEASER_BELOW) & reduce(lambda a, b: a | b, [t.rlike(p) for p in TEASERS]))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    n = F.char_length(text)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.substring(text, k, F.lit(2)))))


def bigram_share(title: Column, body: Column) -> Column:
    """Share of the title's bigrams that the body contains."""
    pairs = bigrams(title)
    return F.size(F.filter(pairs, lambda p: F.contains(body, p))) / F.nullif(F.size(pairs), F.lit(0))


def structured_bulletin(title: Column, body: Column) -> Column:
    """A short text that is news all the same: pairs of the title's characters (repeated ones count each time), or signs of a bulletin."""
    time, magnitude, announced = (body.rlike(p) for p in STRUCTURED)
    event = body.rlike(PLACE) & body.rlike(WEATHER)
    n = F.char_length(title)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.substring(title, k, F.lit(2)))
    by_title = (n >= 6) & (F.size(F.filter(pairs, lambda p: F.contains(body, p))) >= F.greatest(F.lit(2), F.floor((n - 1) * 0.2)))
    return F.coalesce(by_title, F.lit(False)) | (time & event) | magnitude | announced


def with_quality(rows: DataFrame, title: str, text: str, url: str | None = None, html: str | None = None) -> DataFrame:
    """Adds ``reasons``: why a body is defective, in order; an empty array if it is not. A null text counts as an empty one, without
    an address or HTML the rules that look at them name nothing.

    Step by step, so that the cleaned text is made once and not once for every rule that looks at it.
    """
    t, raw = F.col(title), F.coalesce(F.col(text), F.lit(""))
    where, page = (F.coalesce(F.col(c), F.lit("")) if c else F.lit("") for c in (url, html))
    out = rows.withColumn("__clean", cleaning.strip_boilerplate(raw))
    out = out.withColumn("__clean", cleaning.strip_consent_wall(cleaning.strip_reader_chrome(F.col("__clean"))))
    out = out.withColumn("__real", F.char_length(cleaning.cut(F.col("__clean"), r"\s+"))).withColumn("__shell", cleaning.template_shell(raw))
    clean, real, shell = F.col("__clean"), F.col("__real"), F.col("__shell")
    # only bodies of such a length need the dearer looks
    out = out.withColumn("__bulletin", F.when(real < 80, structured_bulletin(t, clean)).otherwise(F.lit(False)))
    apart = F.when((F.char_length(t) >= 8) & (real >= 80) & (has_chinese(t) == has_chinese(clean)), bigram_share(t, clean) < 0.15).otherwise(F.lit(False))
    out = out.withColumn("__short", ~shell & ((real < 20) | ((real < 80) & ~F.col("__bulletin")))).withColumn("__apart", apart)
    cited = cleaning.has(F.regexp_replace(clean, "(?i)^References\\s*:?\\s*", ""), cleaning.CITATION) & (count_of(clean, "doi\\.org/") >= 3)
    reasons = F.array_compact(
        F.array(
            F.when(shell, "template-shell"),
            F.when(raw.rlike("字[体号]") & cleaning.has(raw, cleaning.READER_TRACES), "reader-chrome-contamination"),
            F.when(F.substring(raw, 1, 200).rlike(CONSENT), "consent-wall-only"),
            F.when(F.col("__short"), "too-short"),
            F.when(F.col("__apart"), "title-body-mismatch"),
            F.when(where.rlike(TEASER_HOST) & raw.rlike(FEED_TEASER), "source-feed-teaser"),
            F.when(where.rlike(cleaning.SCIENCE_HOST) & cited & ~page.rlike(cleaning.NARRATIVE), "source-references-only"),
            F.when((real < 60) & ~F.col("__short") & ~((real >= 20) & F.col("__bulletin")), "boilerplate-only"),
        )
    )
    return out.withColumn("reasons", reasons).drop("__clean", "__real", "__shell", "__bulletin", "__short", "__apart")


def bigram_overlap(a: Column, b: Column) -> Column:
    """Shared bigrams over the smaller set's size."""
    x, y = bigrams(a), bigrams(b)
    return F.size(F.array_intersect(x, y)) / F.nullif(F.least(F.size(x), F.size(y)), F.lit(0))


def headings(html: Column) -> Column:
    """(level, text) of the headings, in order."""
    whole = F.regexp_extract_all(html, F.lit("(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    return F.transform(whole, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), strip_tags(h).alias("text")))


def markdown_links(text: Column) -> Column:
    """(title, url) of links whose title has six characters at least; images do not count."""
    plain = F.regexp_replace(text, "!\\[[^\\]]*\\]\\([^)]*\\)", "")
    whole = F.regexp_extract_all(plain, F.lit("\\[[^\\]]{6,}\\]\\((?:https?://[^)\\s]+|/[^)\\s]*)[^)]*\\)"), F.lit(0))
    pick = lambda m, k: F.regexp_extract(m, "\\[([^\\]]{6,})\\]\\(([^)\\s]+)", k)
    return F.transform(whole, lambda m: F.struct(collapse(F.regexp_replace(pick(m, 1), "[*_`#]", "")).alias("title"), pick(m, 2).alias("url")))


def html_links(html: Column) -> Column:
    """(url, title) of anchors."""
    whole = F.regexp_extract_all(html, F.lit("(?is)<a\\b[^>]*href=[\"'][^\"']+[\"'][^>]*>.*?</a>"), F.lit(0))
    return F.transform(whole, lambda a: F.struct(F.regexp_extract(a, "(?is)href=[\"']([^\"']+)", 1).alias("url"), strip_tags(a).alias("title")))


def normalised_tags(tags: Column, synonyms: dict[str, str], allowed: list[str], category: Column, most: int = 6) -> Column:
    """Lower-cased, by synonym, allowed ones only, the category first."""
    table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    clean = F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, F.lower(F.trim(t))), F.lower(F.trim(t))))
    known = F.filter(clean, lambda t: t.isin(*allowed))
    return F.slice(F.array_distinct(F.concat(F.array_compact(F.array(category)), known)), 1, most)


def search_text(*parts: Column) -> Column:
    return F.lower(collapse(F.concat_ws(" ", *parts)))


def model_slug(name: Column) -> Column:
    out = F.regexp_replace(F.lower(name), "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", "-")
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-|-$", "")


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def reading_minutes(text: Column, per_minute: int = 450) -> Column:
    return F.greatest(F.lit(1), F.round(F.char_length(text) / per_minute).cast("int"))
