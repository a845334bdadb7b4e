"""Pages of HTML: readable parts, allowed tags, listings by selectors, JSON in scripts.

Each page is read inside a task, in Arrow batches, and nothing of it is shuffled; what follows (texts, gates, addresses, first of each
address) are expressions and joins of Spark. Null pages count as empty ones; no text of a page ends the job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as cl
from ..functions import markup as mk
from ..functions import text as tx

LEAST_BODY = 120  # characters of a body; what is shorter is a stub
MOST_IMAGES = 12
BATCH = 64  # pages


def per_page(df: DataFrame, columns: list[str], schema: str, f: Callable[..., tuple]) -> DataFrame:
    """df with the columns of schema, which f makes of a row's columns (null texts come as empty ones). Columns of these names are replaced."""
    fields = T.StructType.fromDDL(schema).fields
    df = df.drop(*[x.name for x in fields if x.name not in columns])
    names, taken = df.columns, {x.name for x in fields}
    kept = [n for n in names if n not in taken]
    kinds = [pa.schema([]), *[_arrow(x.dataType) for x in fields]][1:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                rows = [f(*values) for values in zip(*(["" if v is None else v for v in part.column(names.index(c)).to_pylist()] for c in columns), strict=True)]
                new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(n)) for n in kept), *new], [*kept, *(x.name for x in fields)])

    return df.mapInArrow(work, T.StructType([*(df.schema[n] for n in kept), *fields]))


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}[type(kind)]


# ---- allowed tags


def sanitised(df: DataFrame, html: str = "html", base: str | None = None, out: str = "clean") -> DataFrame:
    """Adds ``out``, the page in allowed tags only, its addresses made absolute by the base column."""
    columns = [html] if base is None else [html, base]
    found = per_page(df, columns, f"{out} string", lambda page, url="": (mk.allowed_html(mk.Tree(page), url),))
    return found.withColumn(out, cl.single_figures(F.col(out)))


# ---- the readable part

#: Elements that are never the body, and names that say so; names that speak for one.
ASIDE = frozenset("nav footer aside form menu dialog".split())
UNLIKELY = re.compile(r"(?i)(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|combx|comments?|community|cookie|disqus|extra|foot|footer|header|menu|modal|nav|navbar|pager|pagination|popup|promo|related|remark|rss|share|shoutbox|sidebar|skyscraper|social|sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])")
LIKELY = re.compile(r"(?i)article|body|column|content|entry|hentry|main|page|post|shadow|story|text")
PARAGRAPHS = frozenset("p pre td blockquote".split())
CONTAINERS = frozenset("div section article main dd li figure".split())
TAG_WEIGHT = {"article": 8, "main": 8, "div": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
LEAST_PARAGRAPH, NAME_WEIGHT, LEVELS = 25, 25, 5
COMMAS = re.compile("[,，、;；]")


def best_nodes(tree: mk.Tree) -> tuple[list[int], set[int]]:
    """The nodes that hold the page's body (empty if none does), and the nodes that are left out of it.

    A paragraph of LEAST_PARAGRAPH characters and more gives points, by its length and commas, to the elements it is in: the
    nearest the whole, the next half, those above ever less. An element's points, with a weight for its tag and for what its
    names say, are lowered by the share of its text that is in links. The best one is the body, together with the elements
    beside it that have points of the same order or are plain paragraphs.
    """
    n = len(tree.tag)
    parent, last = np.array(tree.parent), np.array(tree.last)
    out, names = np.zeros(n, bool), [f"{a.get('class', '')} {a.get('id', '')}" for a in tree.attrs]
    for k in range(1, n):
        tag = tree.tag[k]
        unlikely = tag in ASIDE or tag in mk.DROPPED or tag not in (None, "body", "html", "article", "main", "a") and UNLIKELY.search(names[k]) and not LIKELY.search(names[k]) or "hidden" in tree.attrs[k]
        if unlikely and not out[k]:
            out[k : last[k] + 1] = True
    texts = [" ".join(t.split()) if tag is None and not gone else "" for t, tag, gone in zip(tree.text, tree.tag, out, strict=True)]
    upto = lambda values: np.concatenate([[0], np.cumsum(values)])
    below = lambda values: upto(values)[last + 1] - upto(values)[np.arange(n)]
    in_link = np.zeros(n, bool)
    for k in range(1, n):
        if tree.tag[k] == "a":
            in_link[k : last[k] + 1] = True
    length = np.array([len(t) for t in texts])
    total, linked, commas = below(length), below(np.where(in_link, length, 0)), below(np.array([len(COMMAS.findall(t)) for t in texts]))
    lined = below(np.array([t in mk.LINED for t in tree.tag])) - np.array([t in mk.LINED for t in tree.tag])
    density = linked / np.maximum(total, 1)
    points, weighed = np.zeros(n), np.zeros(n, bool)
    for k in np.flatnonzero((total >= LEAST_PARAGRAPH) & ~out).tolist():
        if not (tree.tag[k] in PARAGRAPHS and not (tree.tag[k] == "td" and lined[k]) or tree.tag[k] in CONTAINERS and not lined[k]):
            continue
        worth, up = 1 + commas[k] + min(total[k] // 100, 3), parent[k]
        for level in range(LEVELS):
            if up <= 0:
                break
            points[up] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            weighed[up] = True
            up = parent[up]
    for k in np.flatnonzero(weighed).tolist():
        points[k] += TAG_WEIGHT.get(tree.tag[k], 0) + NAME_WEIGHT * (bool(LIKELY.search(names[k])) - bool(UNLIKELY.search(names[k])))
    points = np.where(weighed & ~out, points * (1 - density), 0)
    best = int(points.argmax())
    gone = set(np.flatnonzero(out).tolist())
    if points[best] <= 0:
        return [], gone
    least, chosen = max(10.0, points[best] / 5), []
    beside = [k for k in range(1, n) if parent[k] == parent[best] and not out[k]]
    for k in beside:
        plain = tree.tag[k] == "p" and (total[k] > 80 and density[k] < 0.25 or 0 < total[k] <= 80 and density[k] == 0 and re.search(r"[.。!！?？](?:\s|$)", tree.words(k)))
        if k == best or points[k] >= least or plain:
            chosen.append(k)
    return chosen, gone


def _body(page: str, url: str) -> tuple[str | None]:
    tree = mk.Tree(page)
    chosen, gone = best_nodes(tree)
    return (mk.allowed_html(tree, url, chosen, gone) or None,) if chosen else (None,)


def top_blocks(clean: Column) -> Column:
    """Blocks at the top of HTML in allowed tags, as (text, media, html)."""
    cut = F.split(F.regexp_replace(clean, r"(</(?:p|h[2-5]|ul|ol|blockquote|pre|table|figure|dl|video|picture)>)(?=<(?:p|h[2-5]|ul|ol|blockquote|pre|table|figure|hr|dl|video|picture)\b)", "$1\u0000"), "\u0000")
    return F.transform(cut, lambda b: F.struct(tx.strip_tags(b).alias("text"), b.rlike("<(?:img|video|picture)\\b").alias("media"), b.alias("html")))


def readable(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds body_html, body_text and images (url, width, height) of the readable part: calls to action at its end go, footers and chrome go
    from the text; null where there is none, or a stub or boilerplate only, so that no page has a wrong body."""
    found = per_page(df, [html, url], "body_html string", _body)
    found = found.withColumn("body_html", F.array_join(F.transform(cl.trim_blocks(top_blocks(cl.single_figures(F.col("body_html")))), lambda b: b["html"]), ""))
    found = found.withColumn("body_text", cl.strip_boilerplate(tx.strip_tags(F.col("body_html")), lined=False))  # one line
    good = (F.char_length("body_text") >= LEAST_BODY) & ~cl.boilerplate_body(F.col("body_text"), lined=False)
    tags = F.slice(F.regexp_extract_all("body_html", F.lit(r'(<img\b[^>]*\bsrc="[^"]+"[^>]*>)'), F.lit(1)), 1, MOST_IMAGES)
    number = lambda tag, name: F.nullif(F.regexp_extract(tag, rf'\b{name}="(\d+)"', 1), F.lit("")).try_cast("int")
    image = lambda tag: F.struct(F.replace(F.regexp_extract(tag, r'\bsrc="([^"]+)"', 1), F.lit("&amp;"), F.lit("&")).alias("url"), number(tag, "width").alias("width"), number(tag, "height").alias("height"))
    return found.withColumns({"images": F.when(good, F.transform(tags, image)), "body_html": F.when(good, F.col("body_html")), "body_text": F.when(good, F.col("body_text"))})


# ---- listings

TAXONOMY = r"(?i)/(label|labels|tag|tags|category|categories|author|authors|page)(/|$)"
ARCHIVE = r"/(19|20)\d{2}(/\d{1,2})?/?$"
_ITEMS = "array<struct<position int, url string, title string, date string>>"


def listing(df: DataFrame, html: str = "html", base: str = "url", item: str | None = None, link: str | None = None, title: str | None = None, date: str | None = None, sections: bool = False) -> DataFrame:
    """Adds ``items``, what a page lists: of each element that fits the item selector (each link, without one) the absolute address, the
    title and the text of its date, as they stand on the page. Addresses of other kinds than http and https, the page itself (unless its
    sections are posts) and items without a title are left out; of one address the first stays."""
    item_at, link_at, title_at, date_at = (mk.Selector(s) if s else None for s in (item or "a[href]", link, title, date))
    anchor = mk.Selector("a[href]")

    def rows(page: str, here: str) -> tuple[list[dict]]:
        tree, out, seen = mk.Tree(page), [], set()
        for position, node in enumerate(item_at.within(tree, 0)):
            at = (link_at or anchor).first(tree, node)
            whole = absolute(tree.attrs[at].get("href"), here) if at is not None else None
            if whole is None or whole in seen or not sections and same_listing(whole, here):
                continue
            shown = title_at.first(tree, node) if title_at else at
            words = " ".join((tree.words(shown) if shown is not None else "").split()) or " ".join(tree.attrs[at].get("title", "").split())
            when = date_at.first(tree, node) if date_at else None
            if words:
                seen.add(whole)
                out.append({"position": position, "url": whole, "title": words, "date": None if when is None else tree.attrs[when].get("datetime") or tree.attrs[when].get("title") or " ".join(tree.words(when).split())})
        return (out,)

    return per_page(df, [html, base], f"items {_ITEMS}", rows)


def absolute(href: str | None, base: str) -> str | None:
    """An http or https address; one to the page's own https site keeps https."""
    whole = mk.address(href, base) if href else None
    try:
        to, here = urlsplit(whole or ""), urlsplit(base)
    except ValueError:
        return None
    if to.scheme.lower() not in ("http", "https") or not to.netloc:
        return None
    return to._replace(scheme="https").geturl() if to.scheme == "http" and here.scheme == "https" and to.netloc == here.netloc else whole


def same_listing(url: str, listing_url: str) -> bool:
    """A link back to the listing: same host and path, and every parameter of the listing kept."""
    u, here = urlsplit(url), urlsplit(listing_url)
    if (u.netloc, u.path.removesuffix("/")) != (here.netloc, here.path.removesuffix("/")):
        return False
    own = dict(reversed([p.partition("=")[::2] for p in u.query.split("&") if p]))
    return all(own.get(k) == v for k, _, v in (p.partition("=") for p in here.query.split("&") if p))


def is_taxonomy(url: Column) -> Column:
    """Pages of labels, authors, numbers and years: navigation, not posts."""
    path = F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return path.rlike(TAXONOMY) | path.rlike(ARCHIVE)


# ---- JSON in scripts

DEEPEST_KEY = 12
_SCRIPT = re.compile(r"(?is)<script[^>]*>(.*?)</script>")
_FLIGHT = re.compile(r'(?s)"((?:[^"\\]++|\\.)*+)"\]\)\s*$')


def balanced(text: str, start: int) -> str | None:
    """The object or list that begins at start, to the bracket that closes it; brackets inside strings don't count."""
    depth, quote, k = 0, "", start
    for m in re.compile(r"""["'\[\]{}]|\\.""", re.S).finditer(text, start):
        sign = m[0]
        if quote:
            quote = "" if sign == quote else quote
        elif sign in "\"'":
            quote = sign
        elif sign in "[{":
            depth += 1
        elif sign in "]}":
            depth -= 1
            if depth == 0:
                return text[start : m.end()]
            if depth < 0:
                return None
        k = m.end()
    return None


def list_of_key(value: object, key: str) -> list | None:
    """The first list under the key, in the order of the document, DEEPEST_KEY levels down at most."""
    stack = [(value, 0)]
    while stack:
        own, depth = stack.pop()
        if depth > DEEPEST_KEY or not isinstance(own, (dict, list)):
            continue
        if isinstance(own, dict) and isinstance(own.get(key), list):
            return own[key]
        stack += [(v, depth + 1) for v in reversed(list(own.values() if isinstance(own, dict) else own))]
    return None


def _parsed(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def variable_json(page: str, name: str) -> str | None:
    """The JSON that a script gives to a variable."""
    m = re.search(rf"(?:window\.)?{re.escape(name)}\s*=\s*", page)
    text = balanced(page, m.end()) if m else None
    return text if text is not None and _parsed(text) is not None else None


def key_json(page: str, key: str) -> str | None:
    """The list that JSON in a script has under a key, at any depth: scripts that are JSON, that give JSON to something, or that push it as
    a string."""
    for m in _SCRIPT.finditer(page):
        body = m[1].strip()
        if f'"{key}"' not in body and f'\\"{key}\\"' not in body:
            continue
        for text in (body, re.sub(r";?\s*$", "", re.sub(r"^[^{\[]*", "", body))):
            if (found := list_of_key(_parsed(text), key)) is not None:
                return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
        pushed = _FLIGHT.search(body)
        text = _parsed(f'"{pushed[1]}"') if pushed else None
        at = text.find(f'"{key}"') if isinstance(text, str) else -1
        if at >= 0:
            opening = re.compile(r"\s*:\s*(?=\[)").match(text, at + len(key) + 2)
            found = _parsed(balanced(text, opening.end()) or "") if opening else None
            if isinstance(found, list):
                return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
    return None


def script_json(df: DataFrame, html: str = "html", variable: str | None = None, key: str | None = None, out: str = "json") -> DataFrame:
    """Adds ``out``: the JSON text that a page's scripts hold in a variable, or the list they hold under a key; null without one."""
    if (variable is None) == (key is None):
        raise ValueError("a variable or a key")
    return per_page(df, [html], f"{out} string", lambda page: (variable_json(page, variable) if variable is not None else key_json(page, key),))
