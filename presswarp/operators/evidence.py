"""What texts prove: the same text barring lost characters, the item a lead is about, a price beside a name, evidence beyond a headline,
readiness for readers, and payloads without what readers don't get. Column expressions; nulls are said for each."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as cl
from ..functions import markup as reader
from ..functions import text as tx
from . import markup as mk

# What stands for a lost character, the share of a lead, the window of a price, calls to read on, shapes of protocols, the
# length of a short post.
LOST = "�"
LEAD_SHARE = 0.5
PRICE_WINDOW = 800
READ_ON = re.compile(r"(?i)(?:read\s+more|view\s+full\s+(?:article|text)|点击(?:阅读|查看)全文|阅读全文)")
PROTOCOL = ("registered-v13", "published-schema")
SHORT_POST = 60
#: End of fixed values.


def same_barring_loss(a: Column, b: Column) -> Column:
    """Do two renderings differ only where a character was lost: a run of lost ones, on either side, stands for any one. Null counts as empty."""
    plain = lambda t: tx.collapse(F.regexp_replace(F.coalesce(t, F.lit("")), f"{LOST}+", LOST))
    letters = lambda t: F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))

    def alike(x: Column) -> Column:
        same_size = F.char_length(x["a"]) == F.char_length(x["b"])
        lossy = F.contains(x["a"], F.lit(LOST)) | F.contains(x["b"], F.lit(LOST))
        pairs = F.zip_with(letters(x["a"]), letters(x["b"]), lambda p, q: (p == q) | (p == LOST) | (q == LOST))
        return (x["a"] == x["b"]) | F.when(same_size & lossy, F.forall(pairs, lambda ok: ok)).otherwise(False)

    return cl.once(F.struct(plain(a).alias("a"), plain(b).alias("b")), alike)


def letter_pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring letters, without blanks and punctuation, lower case."""
    bare = F.regexp_extract_all(F.regexp_replace(F.lower(text), r"[\s\p{P}]", ""), F.lit("(?s)."), F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(bare, 1, F.greatest(F.size(bare) - 1, F.lit(0))), F.slice(bare, 2, F.greatest(F.size(bare) - 1, F.lit(0))), lambda x, y: F.concat(x, y)))


def lead_item(lead: Column, highlights: Column, items: Column) -> Column:
    """The item (a struct with ``title``) that an edition leads with. Without a lead the first highlight, else the first item; with one the item that
    shares most of the lead's letter pairs, the first of equals, if it shares half of them; null if none does."""
    shares = lambda want: F.transform(items, lambda i, k: F.struct((F.size(F.array_intersect(want, letter_pairs(i["title"]))) / F.size(want)).alias("share"), (-k).alias("turn"), i.alias("item")))
    best = cl.once(letter_pairs(lead), lambda want: F.when(F.size(want) > 0, cl.once(F.array_max(F.transform(shares(want), lambda s: F.struct(s["share"].alias("share"), s["turn"].alias("turn")))), lambda top: F.when(top["share"] >= LEAD_SHARE, F.get(items, -top["turn"])))))
    return F.when(F.coalesce(lead, F.lit("")) == "", F.coalesce(F.get(highlights, F.lit(0)), F.get(items, F.lit(0)))).otherwise(best)


def price_forms(price: Column) -> Column:
    """The ways a page writes a price (a decimal): as it is, with two and with four places."""
    bare = F.regexp_replace(F.regexp_replace(price.cast("decimal(20,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.array_distinct(F.array(bare, price.cast("decimal(20,2)").cast("string"), price.cast("decimal(20,4)").cast("string")))


def stands_alone(text: Column, price: Column) -> Column:
    """Is the price written in the text as a number of its own. A null price is there."""
    alone = lambda form: F.regexp_like(text, F.concat(F.lit(r"(?<![0-9.])"), F.replace(form, F.lit("."), F.lit(r"\.")), F.lit(r"(?![0-9])")))
    return price.isNull() | F.exists(price_forms(price), alone)


def priced_near(body: Column, names: Column, prices: list[Column], window: int = PRICE_WINDOW) -> Column:
    """Do all prices stand within ``window`` characters of the first place of one of the names. False without a text or names."""

    def near(text: Column) -> Column:
        def beside(name: Column) -> Column:
            at = F.position(F.trim(name), text)
            start = F.greatest(at - window, F.lit(1))
            segment = F.substring(text, start, (at - start + F.char_length(F.trim(name)) + window).cast("int"))
            ok = cl.once(segment, lambda s: F.forall(F.array(*[stands_alone(s, p) for p in prices]), lambda x: x))
            return (F.trim(name) != "") & (at > 0) & ok

        return F.exists(F.filter(names, lambda n: n.isNotNull()), beside)

    return F.coalesce(cl.once(F.regexp_replace(body, r"\s+", " "), near), F.lit(False))


def _bare(value: str) -> str:
    """The letters and digits of a text or of a page's words, folded, without addresses, handles and calls to read on."""
    tree = reader.Tree(re.sub(r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", "", value))
    text = unicodedata.normalize("NFKC", tree.words(0))
    text = READ_ON.sub("", re.sub(r"(?:^|\s)@[A-Za-z0-9_]+", "", re.sub(r"(?i)https?://\S+", "", text)))
    return "".join(c for c in text if unicodedata.category(c)[0] not in "PSZ" and not c.isspace()).lower()


def with_evidence(df: DataFrame, title: str, excerpt: str, body: str, body_status: str, post: str, quoted: str, out: str = "evidence") -> DataFrame:
    """Adds ``out``: does the material say anything beyond its headline. An excerpt, or a body that is whole, must have a letter that is left when
    the headline is taken out, and not be a part of it; a post's own or quoted words are evidence by themselves."""
    names = [f"_bare{k}" for k in range(5)]
    columns = [title, excerpt, body, post, quoted]
    rows = mk.per_page(df, columns, ", ".join(f"{n} string" for n in names), lambda *texts: tuple(map(_bare, texts)))
    headline, first, second, own, quote = (F.col(n) for n in names)
    letter = lambda c: c.rlike(r"\p{L}")
    more = lambda c: letter(c) & ~((headline != "") & F.contains(headline, c)) & letter(F.when(headline != "", F.replace(c, headline, F.lit(""))).otherwise(c))
    return rows.withColumn(out, more(first) | (F.coalesce(F.col(body_status) == "ok", F.lit(False)) & more(second)) | letter(own) | letter(quote)).drop(*names)


def protocol(source: Column, meta: Column) -> Column:
    """What a score is comparable with, by a source's metadata (JSON): the first of index version, edition, release and benchmark version there is."""
    value = lambda k: F.get_json_object(meta, f"$.{k}")
    named = lambda k: F.when(value(k).isNotNull(), F.concat(F.lit(f"{k}="), value(k)))
    edition = F.concat(named("editionId"), F.coalesce(F.concat(F.lit(";"), named("datasetVersion")), F.lit("")))
    tag = F.coalesce(named("intelligenceIndexVersion"), edition, F.when(source.startswith("livebench"), named("release")), named("benchmarkVersion"), F.lit(PROTOCOL[1]))
    return F.concat(source, F.lit(f":{PROTOCOL[0]}:"), tag)


def workflow_ready(publications: DataFrame, articles: DataFrame, sources: DataFrame, analyses: DataFrame, translations: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Publications that readers may see whole: analysed at the revision of now and passed, with a title and a summary, public, of a source with full
    texts, and with a whole body that is Chinese, or a short post, or translated. media: (article_id, revision) whose media are ready; None leaves media out.

    publications: (article_id, analysis_id, title, summary, visibility, body_mode, channel); articles: (article_id, source_id, revision, body_status,
    body_text, language, post_text); sources: (source_id, site_fulltext); analyses: (analysis_id, article_id, input_revision, relevance);
    translations: (article_id, lang, revision, complete, body_html, body_text).
    """
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    there = F.col("p.title").isNotNull() & said(F.col("p.title")) & said(F.col("p.summary")) & (F.col("p.visibility") == "public") & (F.col("p.body_mode") == "full")
    done = translations.filter((F.col("lang") == "zh") & F.col("complete") & said(F.col("body_html")) & said(F.col("body_text")) & F.col("body_text").rlike(tx.CJK_WIDE)).select("article_id", "revision").distinct().withColumn("translated", F.lit(True))
    rows = publications.alias("p").filter(there).join(articles.alias("a"), F.col("p.article_id") == F.col("a.article_id")).join(sources.filter("site_fulltext").alias("s"), F.col("a.source_id") == F.col("s.source_id"), "left_semi")
    passed = (F.col("n.analysis_id") == F.col("p.analysis_id")) & (F.col("n.article_id") == F.col("a.article_id")) & (F.col("n.input_revision") == F.col("a.revision")) & (F.col("n.relevance") == "pass")
    rows = rows.join(analyses.alias("n"), passed, "left_semi")
    rows = rows.join(done.alias("t"), (F.col("t.article_id") == F.col("a.article_id")) & (F.col("t.revision") == F.col("a.revision")), "left")
    chinese = (F.col("a.language") == "zh") | ((F.coalesce("a.language", F.lit("")) != "en") & F.substring("a.body_text", 1, 400).rlike(tx.CJK_WIDE))
    post = F.trim(F.regexp_replace(F.coalesce("a.post_text", "a.body_text"), r"https?://[^\s]+", ""))
    readable = chinese | ((F.col("p.channel") == "x") & (F.char_length(post) < SHORT_POST)) | F.col("t.translated")
    rows = rows.filter((F.col("a.body_status") == "ok") & F.coalesce(readable, F.lit(False)) & said(F.col("a.body_text")))
    if media is not None:
        rows = rows.join(media.alias("m"), (F.col("m.article_id") == F.col("a.article_id")) & (F.col("m.revision") == F.col("a.revision")), "left_semi")
    return rows.select("p.*")


def pruned(payload: Column, schema: str, fields: list[str]) -> Column:
    """JSON without fields (paths by dots), through its schema."""
    return F.to_json(F.from_json(payload, schema).dropFields(*fields), {"ignoreNullFields": "false"})


#: The documents of editions: what of them an index reads.
EDITION = "lead string, headline string, title string, overview string, periodStart string, periodEnd string, {groups} array<struct<{label}: string, {items}: array<struct<itemId: string, title: string, sourceUrl: string, links: struct<original: string>>>>>"


def report_index(kind: str, content: Column) -> Column:
    """The index entry of an edition's document (JSON): its head, and of each group the label and the items' ids, titles and source addresses (the
    original link where there is none), in order; groups are sections in dailies, themes in others."""
    groups, label, items = ("sections", "label", "items") if kind == "daily" else ("themes", "heading", "storyRefs")
    doc = F.from_json(content, EDITION.format(groups=groups, label=label, items=items))
    none = lambda k: F.array().cast(k)
    entry = lambda i: F.struct(i["itemId"].alias("itemId"), i["title"].alias("title"), F.coalesce(i["sourceUrl"], i["links"]["original"]).alias("sourceUrl"))
    cited = lambda g: F.coalesce(F.transform(g[items], entry), none("array<struct<itemId: string, title: string, sourceUrl: string>>"))
    index = F.coalesce(F.transform(doc[groups], lambda g: F.struct(g[label].alias(label), cited(g).alias(items))), none(f"array<struct<{label}: string, {items}: array<struct<itemId: string, title: string, sourceUrl: string>>>>"))
    return F.struct(*[doc[k].alias(k) for k in ("lead", "headline", "title", "overview", "periodStart", "periodEnd")], index.alias(groups))
