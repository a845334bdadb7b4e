"""Feeds of every kind, RSS 2.0, RDF and Atom with media, and the validators of what was read before.

A feed is read whole, by a tolerant reader, in the task that has it: entries in order, addresses made absolute by what xml:base says or by
the address that the bytes came from. What entries' texts make (bodies, excerpts, times) are expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as mk
from ..functions.dates import parse_published
from ..functions.text import collapse, is_teaser, strip_tags
from ..operators import markup as om
from .readers import BODY_ABOVE

MOST_MEDIA, MOST_EXCERPT = 6, 2000
_MEDIA = "array<struct<kind: string, url: string, poster: string, width: int, height: int>>"
ENTRY = f"array<struct<position: int, url: string, title: string, author: string, published: string, updated: string, body_html: string, summary: string, categories: array<string>, media: {_MEDIA}, guid: string>>"


class _Node:
    """An element of a feed, with what feeds ask of one."""

    def __init__(self, tree: mk.Tree, at: int):
        self.tree, self.at = tree, at
        self.children: dict[str, list[int]] = {}
        k = at + 1
        while k <= tree.last[at]:
            if tree.tag[k]:
                self.children.setdefault(tree.tag[k], []).append(k)
            k = tree.last[k] + 1

    def all(self, name: str) -> list[_Node]:
        return [_Node(self.tree, k) for k in self.children.get(name, ())]

    def text(self, *names: str) -> str:
        """The text of the first of these that says something."""
        return next((t for n in names for k in self.children.get(n, ()) if (t := self.tree.words(k).strip())), "")

    def get(self, attribute: str) -> str:
        return self.tree.attrs[self.at].get(attribute, "")

    def media(self, name: str) -> list[_Node]:
        """Parts of the media namespace, whatever prefix it has: media's own first."""
        own = [n for n in self.children if n == f"media:{name}"] or [n for n in self.children if n == name] or [n for n in self.children if n.endswith(f":{name}")]
        return self.all(own[0]) if own else []


def _number(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() and 0 < int(text) < 1 << 31 else None


def _still(node: _Node, url: str) -> tuple[str, list[dict]]:
    """The description of a node's media, and its widest still: a video with this picture where a video is named."""
    scopes = [g for g in node.media("group") if any(g.media(n) for n in ("description", "thumbnail", "videoid"))] + [node]
    words = next((t for s in scopes for d in s.media("description") if (t := node.tree.words(d.at).strip())), "")
    video = next((t for s in scopes for d in s.media("videoid") if (t := node.tree.words(d.at).strip())), "")
    stills = [t for s in scopes for t in s.media("thumbnail") if t.get("url")]
    best = max(stills, key=lambda t: _number(t.get("width")) or 0, default=None)
    at = mk.address(best.get("url"), url) if best else None
    if at is None:
        return words, []
    return words, [{"kind": "video" if video else "image", "url": url if video else at, "poster": at if video else None, "width": _number(best.get("width")), "height": _number(best.get("height"))}]


def _images(html: str, url: str) -> list[dict]:
    """Images of a body with a source, each address once."""
    tree, out = mk.Tree(html), {}
    for k, tag in enumerate(tree.tag):
        a = tree.attrs[k]
        at = mk.address(mk.source_image(a.get("data-src") or a.get("data-original") or a.get("src") or ""), url) if tag == "img" else None
        if at:
            out.setdefault(at, {"kind": "image", "url": at, "poster": None, "width": _number(a.get("width", "")), "height": _number(a.get("height", ""))})
    return list(out.values())


def _plain(title: str) -> str:
    tree = mk.Tree(title)
    return " ".join(tree.words(0).split())


def _item(it: _Node, base: str, summary_is_body: bool) -> dict | None:
    base = mk.address(it.get("xml:base"), base) or base
    url, title = om.absolute(it.text("link"), base) or om.absolute(it.text("guid"), base), _plain(it.text("title"))
    if not url or not title:
        return None
    plain, longer = it.text("description"), it.text("dc:description")
    summary = longer if len(longer) > len(plain) else plain
    raw = it.text("content:encoded") or (summary if summary_is_body else "")
    enclosed = next((e for e in it.all("enclosure") if e.get("type").startswith("image/")), None)
    first = mk.address(enclosed.get("url"), url) if enclosed else None
    words, still = _still(it, url)
    media = [{"kind": "image", "url": first, "poster": None, "width": None, "height": None}] if first else []
    media += _images(raw, url) if raw else []
    return {
        "url": url, "title": title, "author": it.text("dc:creator", "author") or None, "published": it.text("pubdate", "dc:date", "published") or None, "updated": None, "body_html": mk.allowed_html(mk.Tree(raw), url) if raw else None,
        "summary": summary or words or None, "categories": [t for c in it.all("category") if (t := it.tree.words(c.at).strip())], "media": (media or ([] if raw else still))[:MOST_MEDIA], "guid": it.text("guid") or None,
    }


def _entry(e: _Node, base: str) -> dict | None:
    base = mk.address(e.get("xml:base"), base) or base
    links = e.all("link")
    own = next((x for x in links if x.get("rel") in ("", "alternate")), links[0] if links else None)
    url, title = om.absolute(own.get("href"), base) if own else None, _plain(e.text("title"))
    if not url or not title:
        return None
    content, (words, still) = e.text("content"), _still(e, url)
    author = next(iter(e.all("author")), None)
    return {
        "url": url, "title": title, "author": (author.text("name") if author else "") or None, "published": e.text("published", "updated") or None, "updated": e.text("updated") or None, "body_html": mk.allowed_html(mk.Tree(content), url) if content else None,
        "summary": e.text("summary") or words or None, "categories": [t for c in e.all("category") if (t := c.get("term") or e.tree.words(c.at).strip())], "media": _images(content, url)[:MOST_MEDIA] if content else still, "guid": e.text("id") or None,
    }


def entries_of(text: str, url: str, summary_is_body: bool = False) -> list[dict] | None:
    """The entries of a feed, in order; None for what is no feed. Entries without an address or a title are left out."""
    tree = mk.Tree(text, xml=True)
    top = _Node(tree, 0)
    rss, rdf, atom = (next(iter(top.all(n)), None) for n in ("rss", "rdf:rdf", "feed"))
    channel = next(iter(rss.all("channel")), None) if rss else rdf
    if channel is not None:
        base = mk.address(channel.get("xml:base"), url) or url
        found = [_item(it, base, summary_is_body) for it in channel.all("item")]
    elif atom is not None:
        base = mk.address(atom.get("xml:base"), url) or url
        found = [_entry(e, base) for e in atom.all("entry")]
    else:
        return None
    return [{"position": k, **x} for k, x in enumerate(found) if x is not None]


def entries(feeds: DataFrame, text: str = "text", url: str = "url", summary_is_body: bool = False) -> DataFrame:
    """feeds: a row a feed, its text and the address it came from. Adds ``entries``; null for what is no feed."""
    return om.per_page(feeds, [text, url], f"entries {ENTRY}", lambda t, u: (entries_of(t, u, summary_is_body),))


def entry_rows(feeds: DataFrame, *keep: str, editorial: bool = True) -> DataFrame:
    """A row an entry, from ``entries``: keep..., position, url, title, author, published, updated, body_html, body, excerpt, categories, media, guid.
    The text is a body if it is long and no teaser (of editorial sources); a teaser is the excerpt where there is none."""
    rows = feeds.select(*keep, F.inline("entries"))
    rows = rows.withColumns({"_text": strip_tags(F.col("body_html")), "_summary": F.substring(collapse(strip_tags(F.col("summary"))), 1, MOST_EXCERPT)})
    teaser = F.lit(editorial) & F.coalesce(is_teaser(F.col("_text")), F.lit(False))
    whole = F.coalesce((F.char_length("_text") > BODY_ABOVE) & ~teaser, F.lit(False))
    excerpt = F.coalesce(F.nullif(F.col("_summary"), F.lit("")), F.when(teaser, collapse(F.col("_text"))))
    moments = {"published": parse_published(F.col("published")), "updated": parse_published(F.col("updated"))}
    return rows.withColumns(moments | {"excerpt": excerpt, "body": F.when(whole, F.col("_text")), "body_html": F.when(whole, F.col("body_html"))}).drop("_text", "_summary", "summary")


# ---- validators

#: Headers that the fetcher itself sets, whatever a source's settings say.
OWNED = "^(if-none-match|if-modified-since|host|content-length|content-type|cookie|authorization|proxy-authorization|api-key|x-api-key|connection|transfer-encoding)$"


def request_headers(settings: Column, accept: Column) -> Column:
    """A source's own headers (a map) with names in lower case, without those the fetcher owns and those without a value, and the kinds accepted."""
    named = F.transform_keys(F.map_filter(settings, lambda k, v: v.isNotNull() & (F.trim(k) != "") & ~F.lower(F.trim(k)).rlike(OWNED)), lambda k, v: F.lower(F.trim(k)))
    own = F.coalesce(named, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(F.create_map(F.lit("accept"), accept), lambda k, v: ~F.map_contains_key(own, k)), own)


def conditional(sources: DataFrame, validators: DataFrame, key: str = "source_id") -> DataFrame:
    """sources: (key, config, url); validators: (key, config_hash, response_url, etag, last_modified) of the last read. Adds config_hash, if_none_match and
    if_modified_since, which are null if the settings have changed since: they may change what is made of the same bytes."""
    sources = sources.withColumn("config_hash", F.sha2(F.col("config"), 256))
    known = validators.select(F.col(key).alias("_k"), F.col("config_hash").alias("_h"), F.col("etag").alias("if_none_match"), F.col("last_modified").alias("if_modified_since"), F.col("response_url").alias("known_url"))
    return sources.join(known, (F.col(key) == F.col("_k")) & (F.col("config_hash") == F.col("_h")), "left").drop("_k", "_h")


def outcomes(fetches: DataFrame) -> DataFrame:
    """fetches: ``conditional`` with (status, response_url, response_etag, response_last_modified). Adds outcome (unchanged, read, again or failed) and the
    validators of now. A 304 of another address than before says nothing and is asked again without validators; a 304 without any is a failure."""
    asked = F.col("if_none_match").isNotNull() | F.col("if_modified_since").isNotNull()
    same = F.col("response_url").eqNullSafe(F.col("known_url"))
    outcome = F.when((F.col("status") == 304) & asked & ~same, "again").when((F.col("status") == 304) & asked, "unchanged").when(F.col("status") == 200, "read").otherwise("failed")
    kept = lambda now, before: F.coalesce(F.col(now), F.when(F.col("status") == 304, F.col(before)))
    return fetches.withColumns({"outcome": outcome, "etag": kept("response_etag", "if_none_match"), "last_modified": kept("response_last_modified", "if_modified_since")})
