import functools
import random
import re

import pytest

from glossa.llm import urlfilter as U

URLS = [
    "https://m.tionble.example.com/en/1?page=2&ref=x", "http://tionble.example.com/de/44", "https://nottionble.example.com/en/1", "https://ththre.example.org/en/7/en/9",
    "https://www.example.net/en/5?utm_source=feed", "https://x.org/fr/1777.html", "HTTPS://X.ORG/FR/123.HTML", "https://x.org/es/1?page=2&ref=x", "http://m.x.org/", "https://x.org/en/5#top", "https://x.org/de/5#top", "", "ftp://example.org/es/3", "notaurl",
]


@functools.cache
def regex(rule):
    return re.compile(U.rule_regex(rule)[0], re.ASCII)


def brute(url, rules):
    if url is None:
        return False, ""
    hits = [i for i, r in enumerate(rules) if regex(r).search(url.lower())]
    return bool(hits) and not any(U.rule_regex(rules[i])[1] for i in hits), ",".join(map(str, hits))


def test_patterns():
    def hit(rule, url):
        return bool(re.search(U.rule_regex(rule)[0], url))

    assert hit("||b.com^", "http://a.b.com/x") and hit("||b.com^", "http://b.com") and not hit("||b.com^", "http://ab.com/") and not hit("||b.com^", "http://b.com.de/")
    assert hit("|http://a*z|", "http://abcz") and not hit("|http://a*z|", "http://abczy")
    assert U.literal_tokens("||ads.example.com^") == ["ads", "com", "example"]
    assert U.literal_tokens("/ban*/img|") == ["img"] and U.literal_tokens("banner") == [] and U.literal_tokens("/^a.*b/") == []


def test_expressions_and_options():
    assert U.rule_regex(r"/banner\d+/") == (r"banner\d+", False) and U.literal_tokens(r"/banner\d+/") == []
    assert U.Index([r"/banner\d+/"], {}).match("http://x.org/Banner77") == [0]
    assert U.rule_regex(r"@@/^a$/") == ("^a$", True) and U.rule_regex("||a.com^$")[0] == U.rule_regex("||a.com^")[0]
    for bad in ("||ads.com^$third-party", "/a$script", "/(/"):
        with pytest.raises(ValueError):
            U.rule_regex(bad)


def test_the_rule_list_is_searched_by_its_tokens():
    rnd = random.Random(3)
    urls = []
    for rule in rnd.sample(U.RULES[18:], 60):
        urls += ["http://" + re.sub(r"[*^|]", "", rule.removeprefix("@@").lstrip("|/")) for _ in range(2)] + [f"https://m.thsh.example.com/en/{rnd.randrange(2000)}.html"]
    index = U.Index(U.RULES, {t: 1 if t.isdigit() else 9 if len(t) > 4 else 99 for r in U.RULES for t in U.literal_tokens(r)} | {"example": 999})
    for u in urls:
        found = index.match(u)
        assert (index.blocked(found), ",".join(map(str, found))) == brute(u, U.RULES)
    assert index.tried < 0.05 * len(urls) * len(U.RULES)


def test_random_rules_against_all_regexes():
    rnd = random.Random(2)
    parts = ["ads", "x", "img", "page", "top", "com", "/", "/", ".", "*", "^", "?", "=", "-"]
    for _ in range(30):
        rules = [rnd.choice(["", "||", "|", "@@", "@@||"]) + "".join(rnd.choices(parts, k=rnd.randint(1, 5))) + rnd.choice(["", "|"]) for _ in range(20)]
        index = U.Index(rules, {"com": 9, "ads": 1})
        for _ in range(60):
            url = rnd.choice(["http://", "https://", ""]) + "".join(rnd.choices([p for p in parts if p not in "*^"], k=rnd.randint(1, 9)))
            found = index.match(url)
            assert (index.blocked(found), ",".join(map(str, found))) == brute(url, rules)


def test_the_rarest_token_saves_regexes():
    rules = [f"||host{i}.example.com^" for i in range(500)]
    index = U.Index(rules, {"com": 1000, "example": 1000, **{f"host{i}": 1 for i in range(500)}})
    assert index.match("http://host7.example.com/") == [7] and index.tried == 1


@pytest.mark.parametrize("most", [U.MAX_RULES, 0])
def test_table(spark, monkeypatch, most):
    monkeypatch.setattr(U, "MAX_RULES", most)
    rules = [*U.KINDS, *U.RULES[18:400:3], r"/\d{4}/", r"/(?i:PAGE)=2|\/es\/(?=1)/"]
    rows = [(i, u, "z") for i, u in enumerate(URLS)] + [(90, None, "z"), (0, URLS[0], "z"), (91, "https://x.org/" + "a/" * 50_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, blocked string")
    got = sorted((r.page_id, r.url or "", r.blocked, r.rules) for r in U.url_filter(pages, rules).collect())
    assert got == sorted((i, u or "", *brute(u, rules)) for i, u, _ in rows)
    assert {r[2] for r in U.url_filter(pages, []).collect()} == {False}
    assert U.url_filter(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        U.url_filter(pages, keep=("page_id", "blocked"))
