"""Rules of sources, pools, boards and calendars as Column expressions. Nulls give null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import once
from .text import CJK, DEICTIC

# Markers, hosts, error texts, limits and labels.
TRANSPORT_ERROR = "(connect failed|fetch failed|ECONN|CONNECT_TIMEOUT|connection.*closed|network|HTTP (429|5[0-9]{2}))"
ATTEMPT_CEILING = 6
OFFICIAL = r"(^|\.)(gov|gov\.cn|edu|edu\.cn|ac\.[a-z]{2}|int|mil)(\.|$)"
RESEARCH = r"(^|\.)(nature\.com|science\.org|wiley\.com|sciencedirect\.com|springer\.com|link\.springer\.com|tandfonline\.com|sagepub\.com|mdpi\.com|frontiersin\.org|copernicus\.org|agu\.org|geoscienceworld\.org|jstor\.org|arxiv\.org|biorxiv\.org|ssrn\.com)$"
NEWS = r"(^|\.)(reuters\.com|apnews\.com|bbc\.com|theguardian\.com|xinhuanet\.com|people\.com\.cn|cctv\.com|chinadaily\.com\.cn|scmp\.com|nytimes\.com|washingtonpost\.com|aljazeera\.com|ft\.com|economist\.com)$"
BLOCKED = r"(^|\.)(x\.com|twitter\.com|reddit\.com|facebook\.com|instagram\.com|tiktok\.com|youtube\.com|youtu\.be|linkedin\.com|medium\.com|substack\.com|wikipedia\.org|news\.google\.com|bing\.com|baidu\.com|zhihu\.com|weibo\.com|douban\.com|bilibili\.com|quora\.com|pinterest\.com|t\.me)(\.|$)"
DAILY_QUOTA = "free-models-per-day|insufficient_quota|exceeded your current quota|FreeTierError|今日文本额度已用完|额度已用[尽完]|购买加量包|insufficient balance|积分余额不足"
CONFIG_REFUSED = "switched off in Magpie|is not supported by the current model|unknown or disabled model|account is signed out|sign in again|request illegal"
SUSPENDED = r"100003|account[^\n]{0,40}(suspended|disabled|banned|停用|封禁)|账号[^\n]{0,20}(已被停用|已被封禁|被停)"
FEED_ITEMS, FEED_DAYS = 5, 30
COMPLETED_HOURS = 6
SEARCH_BODY = 12000
REPORT_SUMMARY = 300
KANA, HANGUL = "[\\u3040-\\u30ff]", "[\\uac00-\\ud7af]"
CONFIG_TOKEN = r"^(reasoning|non-reasoning|thinking|non-thinking|adaptive-reasoning|(x?high|medium|low|max|minimal)(-effort)?|thinking-(\d+k|minimal)|high-\d+k|default-fallback|.+-fallback|\d+|\d+-\d+)$"
TIERS = ((r"^max(-effort)?$", 600, "Max 推理"), (r"^xhigh(-effort)?$", 550, "xHigh 推理"), (r"^high(-effort|-\d+k)?$", 500, "High 推理"), (r"^medium(-effort)?$", 300, "Medium 推理"), (r"^low(-effort)?$", 200, "Low 推理"), (r"^minimal$", 100, "Minimal 推理"))
HYBRID = "混合模型或回退配置，不能代表单个模型的能力。"
FNV_START, FNV_PRIME = 0x811C9DC5, 0x01000193


def deictic(text: Column) -> Column:
    """Names the text a time that depends on the day of reading?"""
    return text.rlike(DEICTIC)


def marker(text: Column, words: list[str]) -> Column:
    """Does the (lower-cased) text have one of the words, as a word of its own or in the plural? Blank words match nothing."""
    known = [w.strip().lower() for w in words if w.strip()]
    if not known:
        return F.lit(False)
    escaped = ["".join(c if c.isalnum() or c == " " else "\\" + c for c in w) for w in known]
    plain, other = [e for e, w in zip(escaped, known, strict=True) if w.isascii()], [e for e, w in zip(escaped, known, strict=True) if not w.isascii()]
    return text.rlike("|".join([*([f"(^|[^a-z])({'|'.join(plain)})s?([^a-z]|$)"] if plain else []), *other]))


def noise(title: Column, excerpt: Column, categories: Column, rule: dict) -> Column:
    """Is an item dropped: categories denied or not allowed, a title without a required marker, then kept by ``keep``, else
    dropped by markers of the title or of both. rule: deny, allow, require, keep, drop_title, drop (lists of words)."""
    of = lambda k: rule.get(k) or []
    cats = F.coalesce(categories, F.array().cast("array<string>"))
    low = F.lower(title)
    both = F.concat(low, F.lit("\n"), F.lower(F.coalesce(excerpt, F.lit(""))))
    overlap = lambda words: F.arrays_overlap(cats, F.array(*map(F.lit, words))) if words else F.lit(False)
    out = F.when(overlap(of("deny")), True)
    if of("allow"):
        out = out.when(~overlap(of("allow")), True)
    if of("require"):
        out = out.when(~marker(low, of("require")), True)
    return out.when(marker(both, of("keep")), False).otherwise(marker(low, of("drop_title")) | marker(both, of("drop")))


def attempt_blocked(outcome: Column, attempts: Column, reason: Column, updated: Column, now: Column) -> Column:
    """No new attempt: finished, too many tries, or tried within the back-off of its kind of failure."""
    transport = (outcome == "failed") & F.coalesce(reason, F.lit("")).rlike("(?i)" + TRANSPORT_ERROR)
    wait = F.when(transport, 300).when(attempts >= ATTEMPT_CEILING, 6 * 3600).otherwise(300)
    recent = F.unix_micros(updated) > F.unix_micros(now) - wait.cast("bigint") * 1_000_000
    return outcome.isin("skipped", "translated") | ((attempts >= ATTEMPT_CEILING) & (outcome != "partial") & ~transport) | (outcome.isin("failed", "partial") & recent)


def needs_media(html: Column, videos: Column) -> Column:
    """A body with a picture or a poster from the web, or a video (an array of structs with kind and poster) with one."""
    pattern = "(?i)<img\\s[^>]*src\\s*=\\s*['\"]https?://|<video\\s[^>]*poster\\s*=\\s*['\"]https?://"
    poster = F.exists(F.coalesce(videos, F.array().cast("array<struct<kind:string,poster:string>>")), lambda m: (m["kind"] == "video") & F.coalesce(m["poster"].rlike("(?i)^https?://"), F.lit(False)))
    return F.coalesce(html, F.lit("")).rlike(pattern) | poster


def first_image(media: Column, least: int = 480, unknown: int = 800) -> Column:
    """The first image wide enough; a width that is not known counts as ``unknown``. media: array of (kind, url, width)."""
    return F.try_element_at(F.filter(media, lambda m: (m["kind"] == "image") & (F.coalesce(m["width"], F.lit(unknown)) >= least)), F.lit(1))


def report_text(title: Column, summary: Column) -> Column:
    return F.concat(title, F.lit("。"), F.substring(F.coalesce(summary, F.lit("")), 1, REPORT_SUMMARY))


def search_body(text: Column, mode: Column) -> Column:
    """What of a body can be searched: its lower-cased start where the whole may be shown, else nothing."""
    return F.when(mode == "full", F.lower(F.substring(F.coalesce(text, F.lit("")), 1, SEARCH_BODY))).otherwise("")


def display_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: ~t.startswith("entity:"))


def canonical_source(url: Column, topic: Column) -> Column:
    """A source's address without fragment, utm_ parameters and end slashes, in its own case, and the topic that tells sources at
    one address apart. Null for no address."""
    u = F.split_part(url, F.lit("#"), F.lit(1))
    u = F.regexp_replace(u, "([?&])utm_[^&]*", "$1")
    u = F.regexp_replace(F.regexp_replace(u, "^(.*?)&&", "$1?"), "/+$", "")
    slug = F.lower(F.regexp_replace(F.coalesce(topic, F.lit("")), "\\s+", "-"))
    return F.when((url != "") & (slug != ""), F.concat(u, F.lit("#"), slug)).when(url != "", u)


def host_kind(host: Column) -> Column:
    return (
        F.when(F.coalesce(host, F.lit("")) == "", "invalid").when(host.rlike("(?i)" + BLOCKED), "blocked").when(host.rlike("(?i)" + OFFICIAL), "official")
        .when(host.rlike("(?i)" + RESEARCH), "research").when(host.rlike("(?i)" + NEWS), "news").when(host.endswith(".org"), "organization").otherwise("other")
    )


def host_base(kind: Column) -> Column:
    return F.when(kind.isin("invalid", "blocked"), -1).when(kind == "official", 4).when(kind == "research", 3).when(kind == "organization", 2).when(kind == "news", 1).otherwise(0)


def host_score(kind: Column, engines: Column, best_rank: Column, feed: Column) -> Column:
    """(quality 0 to 10, eligible) of a host that so many engines found, at this rank at best, with a feed or none."""
    base = host_base(kind)
    quality = base + F.least(engines, F.lit(3)) + F.when(best_rank <= 3, 2).when(best_rank <= 10, 1).otherwise(0) + F.when(feed, 2).otherwise(0)
    quality = F.greatest(F.lit(0), F.least(F.lit(10), quality))
    return F.struct(quality.cast("int").alias("quality"), (feed & ~kind.isin("invalid", "blocked") & ((engines >= 2) | (base >= 3) | (quality >= 6))).alias("eligible"))


def feed_verdict(status: Column, items: Column, latest: Column, now: Column) -> Column:
    days = F.round((F.unix_micros(now) - F.unix_micros(latest)) / 86_400_000_000, 1)
    return F.when(status.isNotNull() & ~status.between(200, 299), "http").when(items < FEED_ITEMS, "too-few-items").when(latest.isNull(), "no-dated-items").when(days > FEED_DAYS, "stale").otherwise("ok")


def month_span(month: Column) -> Column:
    first = F.to_date(F.concat(month, F.lit("-01")))
    return F.struct(F.date_format(first, "yyyy-MM-dd").alias("first"), F.date_format(F.last_day(first), "yyyy-MM-dd").alias("last"))


def presentation(status: Column, in_progress: Column, through: Column, now: Column) -> Column:
    late = F.unix_micros(now) >= F.unix_micros(through) + COMPLETED_HOURS * 3_600_000_000
    return F.when(status == "confirmed", "confirmed").when(in_progress, "in_progress").when(through.isNull() | (now < through), "announced").when(late, "likely_completed").otherwise("expired_unconfirmed")


def confidence(sensitive: Column, coverage: Column) -> Column:
    return F.when(sensitive, "LOW").when(F.coalesce(coverage, F.lit(0.0)) >= 0.7, "HIGH").otherwise("MEDIUM")


def shard_of(key: Column, shards: int) -> Column:
    """A stable shard of a key of ASCII characters, by FNV-1a over 32 bits."""
    size = 1 << 32
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(FNV_PRIME).cast("bigint"), F.lit(size))
    return F.pmod(F.aggregate(F.filter(F.split(key, ""), lambda c: c != ""), F.lit(FNV_START).cast("bigint"), step), F.lit(max(1, shards)))


def cursor(prefix: str, payload: Column) -> Column:
    """A struct as an opaque cursor: the prefix and the JSON in base64url without padding."""
    raw = F.base64(F.to_json(payload).cast("binary"))
    return F.concat(F.lit(prefix + "."), F.regexp_replace(F.translate(F.regexp_replace(raw, "\\s", ""), "+/", "-_"), "=+$", ""))


def read_cursor(prefix: str, text: Column, schema: str) -> Column:
    """The payload; null for another prefix or what is no JSON object."""
    body = F.translate(F.substring(text, len(prefix) + 2, 1 << 20), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(4 - F.length(body) % 4, F.lit(4)).cast("int")))
    return F.when(text.startswith(prefix + "."), F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), schema))


def token_count(value: Column) -> Column:
    """A count of up to 18 digits as it stands in JSON; null for anything else."""
    return F.when(value.rlike("^[0-9]{1,18}$"), value).try_cast("bigint")


def cooldown(status: Column, message: Column) -> Column:
    """The kind of rest a refusal asks for; null for none."""
    daily, config, gone = (message.rlike("(?i)" + p) for p in (DAILY_QUOTA, CONFIG_REFUSED, SUSPENDED))
    return (
        F.when(status.isin(401, 403), "auth").when(status == 402, F.when(daily, "quota_day").otherwise("auth")).when(status.isin(400, 404), F.when(config, "config").otherwise("auth"))
        .when(status == 429, F.when(daily, "quota_day")).when(status >= 500, F.when(gone, "auth").when(config, "config"))
    )


def rest_until(category: Column, reset: Column, now: Column, most_seconds: int) -> Column:
    """Until when a member rests: a daily quota to its reset (an hour where that is not known), a limit by the minute to its
    reset (30 minutes at most, one where it is not known), else an hour. In seconds."""
    hour = now + 3600
    known = reset > now
    return F.when(category == "quota_day", F.when(known, F.least(reset, now + most_seconds)).otherwise(hour)).when(category == "rate_minute", F.when(known, F.least(reset, now + 1800)).otherwise(now + 60)).when(category.isNotNull(), hour)


def looks_chinese(text: Column) -> Column:
    return text.rlike(CJK) & ~text.rlike(KANA) & ~text.rlike(HANGUL)


def short_post(text: Column) -> Column:
    """Under 100 characters of Chinese, under 500 of other text; an empty text is none."""
    size, han = F.length(text), F.regexp_count(text, F.lit(CJK))
    return (size > 0) & (size < F.when(han > size * 0.3, 100).otherwise(500))


def chinese_density(text: Column) -> Column:
    total = F.length(F.regexp_replace(text, "\\s+", ""))
    return F.when(total == 0, 0.0).otherwise(F.regexp_count(text, F.lit(CJK)) / total)


def issue_due(kind: Column, first: Column, last: Column, now: Column) -> Column:
    """Is an edition's window closed: 8 o'clock (UTC+8) of a daily's own day, or of the day after a week's or month's last."""
    at = F.unix_seconds(F.when(kind == "daily", first).otherwise(F.date_add(last, 1)).cast("timestamp"))
    return at <= F.unix_seconds(now)


def _names(pattern: str):
    return lambda t: t.rlike(pattern)


def configuration(descriptors: Column) -> Column:
    """(key, label, rank, ineligible) of a run's descriptors (an array of comma-separated strings): the highest effort tier named;
    adaptive runs stand just above their tier, low and medium ones above the default, runs with a fallback just below."""
    slugs = F.transform(F.flatten(F.transform(descriptors, lambda d: F.split(d, "\\s*,\\s*"))), lambda t: F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), "[^a-z0-9]+", "-"), "^-|-$", ""))
    tokens = F.filter(slugs, lambda t: t.rlike(CONFIG_TOKEN) & ~t.rlike(r"^\d+(-\d+)?$"))
    more = lambda pattern: F.transform(F.filter(tokens, lambda t: t.rlike(pattern)), lambda t: F.regexp_extract(t, pattern, 1))
    return once(tokens, lambda own: once(_every_token(own), lambda every: once(_tier(every), lambda tier: _described(F.array_contains(own, "adaptive-reasoning"), every, tier))))


def _every_token(tokens: Column) -> Column:
    """The tokens with those that they contain, each once, in order."""
    more = lambda pattern: F.transform(F.filter(tokens, lambda t: t.rlike(pattern)), lambda t: F.regexp_extract(t, pattern, 1))
    adaptive = F.array_contains(tokens, "adaptive-reasoning")
    every = F.concat(tokens, more("^thinking-(minimal|low|medium|high)$"), F.when(adaptive, more("^(x?high|medium|low)-effort$")).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(every))


def _tier(every: Column) -> Column:
    named = lambda value, name: F.struct(F.lit(value).alias("tier"), F.lit(name).alias("label"))
    plain = F.array_contains(every, "non-reasoning") & (F.size(every) == 1)
    return F.coalesce(*[F.when(F.exists(every, _names(pattern)), named(value, name)) for pattern, value, name in TIERS], F.when(plain, named(50, "非推理配置")), named(400, "来源默认配置"))


def _described(adaptive: Column, every: Column, named: Column) -> Column:
    tier, label, fallback = named["tier"], named["label"], F.exists(every, lambda t: t.endswith("-fallback"))
    low = adaptive & tier.isin(300, 200)
    rank = F.when(low, 450).otherwise(tier) + F.when(adaptive, 2).otherwise(0) - F.when(fallback, 1).otherwise(0)
    label = F.when(low, "自适应推理").when(adaptive, F.concat(label, F.lit(" · 自适应"))).otherwise(label)
    budget = F.try_element_at(F.transform(F.filter(every, lambda t: t.rlike(r"^(?:thinking|high)-\d+k$")), lambda t: F.regexp_extract(t, r"-(\d+k)$", 1)), F.lit(1))
    label = F.concat(label, F.coalesce(F.concat(F.lit(" · "), budget), F.lit("")), F.when(fallback, " · 含来源回退").otherwise(""))
    none = F.size(every) == 0
    return F.struct(
        F.when(none, "source_default:default").otherwise(F.concat(F.lit("first_party:"), F.array_join(every, "+"))).alias("key"),
        F.when(none, "来源默认配置").otherwise(label).alias("label"), F.when(none, 400).otherwise(rank).cast("int").alias("rank"), F.when(~none & fallback, HYBRID).alias("ineligible"),
    )
