"""Names in texts against plain search, both ways, and the guard of copies."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from presswarp.operators import entities as en

NAMES = [("nasa", "NASA"), ("cenc", "中国地震台网中心"), ("cenc", "CENC"), ("usgs", "USGS"), ("who", "WHO"), ("x", "x.(y)*"), ("geo", "Géo Institut"), ("a", "A"), (None, "none"), ("blank", " "), ("null", None), ("nasa", "NASA"), ("long", "National Aeronautics and Space Administration"), ("admin", "Space Administration"), ("emoji", "🌋 watch")]
TEXTS = [
    None, "", "  ", "NASA", "ＮＡＳＡ发布", "xNASA", "NASAx", "NASA，今天", "N A S A", "中国地震台 网中心测定", "中国地震台\n网中心", "中国地震台网 中 心和USGS", "who and WHO", "x.(y)* and x_y", "Géo  Institut", "Géo Institut", "GéoInstitut", "A", "BA", "A-B",
    "the National  Aeronautics and\nSpace Administration", "🌋 watch!", "🌋watch", "WHO" * 3, "nasa",
]


def by_hand(text):
    found = set()
    fold = lambda t, by: re.sub(r"\s+", by, unicodedata.normalize("NFKC", t)).strip()
    for entity, name in NAMES:
        if entity is None or not (name or "").strip() or not text:
            continue
        form = fold(name, " ")
        left, right = ("(?<![A-Za-z0-9])" if re.match("[A-Za-z0-9]", form) else ""), ("(?![A-Za-z0-9])" if re.search("[A-Za-z0-9]$", form) else "")
        if re.search(left + re.escape(form) + right, fold(text, " ")) or en.beyond_ascii(name) and fold(name, "") in fold(text, ""):
            found.add(entity)
    return sorted(found)


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(3)
    pieces = ["NASA", "中国地震台", "网中心", " ", "\n", "x", "USGS", "Space", "Administration", "WHO", ".", "，", "A", "Géo", "Institut"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    rows = [(k, t, "old") for k, t in enumerate(texts)] + [(3, TEXTS[3], "old")]
    return spark.createDataFrame(rows, "k int, text string, found string"), spark.createDataFrame(NAMES, "entity string, name string"), rows


def test_named_both_ways(frames, monkeypatch):
    frame, lexicon, rows = frames
    want = sorted((k, by_hand(t)) for k, t, _ in rows)
    assert sum(bool(x) for _, x in want) > 100
    assert sorted((r.k, r.found) for r in en.named(frame, lexicon, {"found": "text"}).collect()) == want
    monkeypatch.setattr(en, "LEXICON_BYTES", 0)
    assert sorted((r.k, r.found) for r in en.named(frame, lexicon, {"found": "text"}, "k").collect()) == want
    with pytest.raises(ValueError):
        en.named(frame, lexicon, {"found": "text"})
    assert all(r.found == [] for r in en.named(frame, lexicon.limit(0), {"found": "text"}).collect())
    assert en.named(frame.limit(0), lexicon, {"found": "text"}, "k").count() == 0


def test_guard(spark):
    lexicon = spark.createDataFrame([("gov", "应急管理部"), ("nasa", "NASA"), ("gpt", "GPT-5"), ("usgs", "USGS")], "entity string, name string")
    rows = [
        ("named", "NASA 发布数据", "NASA 的新标题", "NASA 说", "NASA data", "https://e.com", None), ("not named", "一份数据", "NASA 的新标题", "NASA 说", "数据发布了", "https://e.com", None), ("not Chinese", "a text", "NASA 标题", "说", "a text", "https://e.com", None),
        ("publisher", "a text", "NASA 标题", "NASA 说", "a", "https://www.data.nasa.gov/x", None), ("other host", "a text", "NASA 标题", "说", "标题在这里", "https://notnasa.gov/x", None), ("owner", "a text", "USGS 标题", "USGS", "a", None, "usgs"),
        ("rejoined", "the GPT 5 model", "GPT-5 标题", "x", "a", None, None), ("alias", "the space agency says", "NASA 标题", "x", "a", None, None), ("spaced", "text", "应急 管理部通报", "应急管理 部说", "原来的标题", None, None), ("nulls", None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "k string, text string, title string, summary string, original string, url string, owner string")
    found = {r.k: r for r in en.guarded(frame, lexicon, ["text"], "title", "summary", "original", "url", "owner", {"nasa.gov": "nasa", "gov": "gov"}, {"(?i)space agency": "nasa"}).collect()}
    assert {k for k, r in found.items() if r.outcome == "pass"} == {"named", "publisher", "owner", "rejoined", "alias", "nulls"}
    assert (found["not named"].guarded_title, found["not named"].guarded_summary, found["not named"].title_unsupported) == ("数据发布了", "", ["nasa"])
    assert found["not Chinese"].guarded_title == "" and found["not Chinese"].guarded_summary == "说"
    assert found["other host"].outcome == "fallback" and found["spaced"].summary_unsupported == ["gov"] and found["spaced"].guarded_title == "原来的标题"
    assert found["nulls"].guarded_title is None and found["named"].guarded_title == "NASA 的新标题"
    assert spark.range(1).select(en.publisher_entity(F.lit("https://a.b.gov"), {})).first()[0] is None
