import random
import re

import duckdb

from failcast.llm import url_rules as U
from tests.conftest import SF01

RULES = U.BASE_RULES + U.PATTERN_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules=RULES):
    host, path = parts(url)

    def base_fits(r):
        h, p = r.text.split("/", 1)
        return (host == h or host.endswith("." + h)) and path.startswith("/" + p)
    key = lambda r: (-len(r.text), r.verdict == "allow", r.text)
    base = min((r for r in rules if r.base and base_fits(r)), key=key, default=None)
    own = min((r for r in rules if not r.base and re.search(r.regex.replace(r"\z", r"\Z"), host + "\n" + path)), key=key, default=None)
    return host, path, base and base.text, (base or own or U.Rule("", "allow")).verdict, own and own.text


HARD = [None, "", "net/", "http://net/", "http://net", "http://a.net?x=://b.org/fr/", "HTTPS://X.Example.NET/en/", "x://example.net/en",
        "x://myexample.com/de/", "x://example.com/de/1", "x://example.com/DE/1", "x://a.org/fr/#q", "x://a.org:80/fr/", "://org/fr/",
        "x://spam-farm.org/", "x://q.spam-policy.com/z", "x://nospam-x.org/a", "x://cheap-blue-pills.com/", "x://a.com/wp-admin/z",
        "x://a.com/1?/wp-admin/", "x://ca\nsino.casino/", "x://é.net/É", "x://casino", "a b://xxx/y", "x://A.SPAM.org", "x://y.com/net/"]


def test_hard_urls(spark):
    rows = [(i, u, "old", 1) for i, u in enumerate(HARD)] + [(0, None, "old", 2), (3, "http://net/", None, 3), (None, "x://net/a", None, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, token int")
    got = U.filter_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict, r.pattern) == brute(r.url), r.url
    assert sorted(r.token for r in got) == sorted(r[3] for r in rows)
    assert U.filter_urls(pages.limit(0)).collect() == []


#: Verdicts and patterns written by hand.
BARE = {"http://spam-farm.org/": "block ^spam-", "http://www.spam-farm.org/": "block ^spam-", "http://casino.com": "block ^casino^",
        "http://x.casino.com/a": "block ^casino^", "http://adult.example.org/x": "block ^adult^", "http://xxx.com": "block ^xxx^",
        "http://cheap-blue-pills.com/": "block ^cheap-*pills^", "http://free-money.biz/win": "block ^free-money^", "http://pills": "block ^pills^",
        "http://a.com/spam": "block ^spam^", "http://no-spam.com/": "block -spam^", "http://spam-policy.com/": "allow ^spam-policy^",
        "http://casinos.com/": "allow None", "http://mycasino.com/": "allow None", "http://nospam-x.org/": "allow None",
        "http://a.com/wp-admin/z": "block /wp-admin/", "http://a.com/wp-admin": "allow None", "http://spam.net/": "block ^spam^"}


def test_bare_hosts(spark, tmp_path):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(BARE)], "page_id long, url string")
    got = {r.url: f"{r.verdict} {r.pattern}" for r in U.filter_urls(pages).collect()}
    assert got == BARE
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(list(BARE) + [u for u in HARD if u])))
    cur = con.execute(U.page_verdicts_sql())
    names = [c[0] for c in cur.description]
    sql = {r["page_id"]: r for r in (dict(zip(names, x)) for x in cur.fetchall())}
    for i, u in enumerate(list(BARE) + [u for u in HARD if u]):
        assert tuple(sql[i][c] for c in ("host", "path", "rule", "verdict", "pattern")) == brute(u), u


def test_random_urls_and_rules(spark):
    rng = random.Random(1)
    bits = ["net", "org", "com", "a", "ads", "x1", "track", "en", "fr"]
    url = lambda: f"http://{'.'.join(rng.choices(bits, k=rng.randint(1, 3)))}/{'/'.join(rng.choices(bits, k=rng.randint(0, 3)))}" + rng.choice(["", "?a=net", "#org"])
    rules = tuple({U.Rule(".".join(rng.choices(bits, k=rng.randint(1, 2))) + "/" + rng.choice(["", "a", "en/", "ads/x"]), rng.choice(["allow", "block"]), True) for _ in range(12)}
                  | {U.Rule(rng.choice(["||", "", "|", "^"]) + rng.choice(bits) + rng.choice(["*", "^", "/", "-", "."]) + rng.choice(bits) + rng.choice(["", "|", "^", "*"]), rng.choice(["allow", "block"])) for _ in range(25)})
    urls = [url() for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in U.filter_urls(pages, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict, r.pattern) == brute(r.url, rules), r.url


def test_tokens_are_shut_in():
    assert U.Rule("net/", "block").tokens == ["net"]
    assert U.Rule("example.net/en/", "allow").tokens == ["en", "example", "net"]
    assert U.Rule("a.com/en", "allow").tokens == ["a", "com"]
    assert U.Rule("ads*x-y^", "block").tokens == ["y"]
    assert U.Rule("||ads.", "block").tokens == ["ads"]
    assert U.Rule("ads", "block").tokens == []


def test_pages(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    want = {r.page_id: brute(r.url) for r in pages.collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, r.pattern) for r in U.page_verdicts(pages).collect()} == want
    verdicts = [w[3] for w in want.values()]
    assert "block" in verdicts and "allow" in verdicts


def test_only_native_plan(spark):
    plan = U.page_verdicts(spark.read.parquet(f"{SF01}/pages.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
