"""URL identity as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that do not identify material.
TRACKING = "(?i)^(?:utm_[a-z]+|spm|from|ref|ref_src|ref_url|source|share_source|share_token|fbclid|gclid|igshid|mc_cid|mc_eid|_hsenc|_hsmi|scene|chksm|sessionid|srcid|clicktime|enterid|mkt_tok)$"
ACCOUNT_HOST, ACCOUNT_KEYS = "mp.weixin.qq.com", ("__biz", "mid", "idx", "sn")

_PARTS = "(?s)^(https?)://([^/?#:]+)(?::(\\d*))?([^?#]*)(?:\\?([^#]*))?"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), "(?i)" + _PARTS, k)


def host(url: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(part(url, 2)), "^www\\.", ""), F.lit(""))


def normalise(url: Column) -> Column:
    """https, lower-case host without www, no default port, fragment or tracking parameter, parameters in order, no trailing
    slash; null for what is no http address. Percent-encodings stay as they are."""
    name, port, path, query = host(url), part(url, 3), part(url, 4), part(url, 5)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    key = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(pairs, lambda p: ~key(p).rlike(TRACKING))
    account = F.filter(F.transform(F.array(*map(F.lit, ACCOUNT_KEYS)), lambda k: F.get(F.filter(pairs, lambda p: key(p) == k), F.lit(0))), lambda p: p.isNotNull())
    ordered = F.transform(F.array_sort(F.transform(kept, lambda p, k: F.struct(key(p).alias("a"), k.alias("b"), p.alias("p")))), lambda x: x["p"])
    query = F.array_join(F.when(name == ACCOUNT_HOST, account).otherwise(ordered), "&")
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    base = F.concat(F.lit("https://"), name, port, F.when(path == "", "/").otherwise(path))
    whole = F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(~path.isin("", "/") & whole.endswith("/"), F.regexp_replace(whole, "/$", "")).otherwise(whole)


def post_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "(?i)(?:x|twitter)\\.com/[^/]+/status(?:es)?/(\\d+)", 1), F.lit(""))


def identity_key(url: Column) -> Column:
    return F.coalesce(F.concat(F.lit("x:"), post_id(url)), F.concat(F.lit("url:"), normalise(url)))


def doi(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(text, "(?i)\\b(10\\.\\d{4,9}/[^\\s\"<>?#]+)", 1), "[.,;)]+$", "")), F.lit(""))


def octets(address: Column) -> Column:
    return F.transform(F.split(address, "\\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))


def internal_address(address: Column) -> Column:
    """Addresses of this host or a private network, IPv4 and IPv6, also those that carry such an IPv4 address inside; what is no address counts as one."""
    return _judged_address(address, _private_v4, False)


def blocked_address(address: Column) -> Column:
    """Addresses never to fetch: internal ones, reserved, multicast and documentation ranges, and tunnels whose end can't be judged."""
    return _judged_address(address, lambda o: _private_v4(o) | _reserved_v4(o), True)


def _private_v4(o: Column) -> Column:
    a, b = F.get(o, F.lit(0)), F.get(o, F.lit(1))
    return a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))


def _reserved_v4(o: Column) -> Column:
    """198.18.0.0/15 is none: local proxies answer from it."""
    a, b, c = (F.get(o, F.lit(k)) for k in range(3))
    return (a >= 224) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 192) & (b == 88) & (c == 99)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))


_V4 = r"^\d{1,3}(?:\.\d{1,3}){3}$"


def ipv6_groups(address: Column) -> Column:
    """The eight numbers of an IPv6 address (with ``::``, a zone, or an IPv4 address at its end); null for what is none."""
    text = F.lower(F.regexp_replace(address, "%.*$", ""))
    dotted = F.regexp_extract(text, r"(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    o = octets(dotted)
    pair = lambda k: F.lower(F.hex(F.get(o, F.lit(k)) * 256 + F.get(o, F.lit(k + 1))))
    text = F.when(dotted == "", text).when(F.forall(o, lambda x: x.between(0, 255)), F.concat(F.regexp_replace(text, r"\d{1,3}(?:\.\d{1,3}){3}$", ""), pair(0), F.lit(":"), pair(2)))

    def groups(t: Column) -> Column:
        halves = F.split(t, "::", -1)
        part = lambda k: F.when(F.coalesce(F.get(halves, F.lit(k)), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(halves, F.lit(k)), ":", -1))
        missing = 8 - F.size(part(0)) - F.size(part(1))
        filled = F.concat(part(0), F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), part(1))
        good = (F.size(halves) <= 2) & (missing >= 0) & ((F.size(halves) == 2) | (missing == 0)) & F.forall(filled, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.transform(filled, lambda g: F.conv(g, 16, 10).cast("int")))

    return F.transform(F.array(text), groups)[0]


def _judged_address(address: Column, v4, reserved: bool) -> Column:
    def judged(g: Column) -> Column:
        n = [F.get(g, F.lit(k)) for k in range(8)]
        inside = lambda hi, lo: v4(F.array(F.shiftright(hi, 8), hi.bitwiseAND(F.lit(255)), F.shiftright(lo, 8), lo.bitwiseAND(F.lit(255))))
        zeros = lambda k: reduce(lambda x, y: x & y, [c == 0 for c in n[:k]])
        nat = (n[0] == 0x64) & (n[1] == 0xFF9B)
        local = (n[0].bitwiseAND(F.lit(0xFE00)) == 0xFC00) | (n[0].bitwiseAND(F.lit(0xFFC0)).isin(0xFE80, 0xFEC0))
        if reserved:  # tunnels, documentation, discarded, multicast
            local = local | ((n[0] == 0x2001) & n[1].isin(0, 0xDB8)) | ((n[0] == 0x100) & (n[1] == 0) & (n[2] == 0) & (n[3] == 0)) | (n[0].bitwiseAND(F.lit(0xFF00)) == 0xFF00)
        return (
            F.when(g.isNull() | (zeros(7) & n[7].isin(0, 1)), True).when(zeros(5) & n[5].isin(0, 0xFFFF), inside(n[6], n[7]))
            .when(nat & (n[2] == 0) & (n[3] == 0) & (n[4] == 0) & (n[5] == 0), inside(n[6], n[7])).when(nat & (n[2] == 1), True).when(n[0] == 0x2002, inside(n[1], n[2])).otherwise(local)
        )

    o = octets(address)
    plain = address.rlike(_V4) & F.forall(o, lambda x: x.between(0, 255))
    return F.coalesce(F.when(plain, v4(o)).otherwise(F.transform(F.array(ipv6_groups(address)), judged)[0]), F.lit(True))


def participant_key(group: Column, source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("group:"), group), F.concat(F.lit("source:"), source))
