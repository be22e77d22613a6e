import random
import re

from dqspark.llm.url_filter import QUERY_RULES, Rule, RuleIndex, url_verdicts

from .helpers import CLASHING

SCHEMA = "page_id bigint, url string, html string"
URLS = [
    "http://www.example.com/en/1",
    "HTTPS://WWW.EXAMPLE.COM/en/1",
    "http://example.com/en/1?x=/fr/#y",
    "http://a.example.com/EN/1",
    "http://badexample.com/en/",
    "http://example.com",
    "http://example.com/",
    "http://example.com?q=/en/",
    "http://x.net/es/",
    "http://net/fr/1",
    "http://x.net/de/",
    "ftp://x.org/en/",
    "no scheme /en/",
    "a://b://c.net/es/",
    "http://user@example.com/en/",
    "http://example.com:80/en/",
    "http://é.net/es/\n",
    "http://-.net/es/",
    "",
    None,
    "://",
    "http://net/es/" + "x" * 200_000,
]


def brute(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m.group(1)), m.group(2)) if m else ("", "")

    def fits(r):
        if host != r.host and not host.endswith("." + r.host):
            return False
        return re.match(".*".join(map(re.escape, r.path.split("*"))), path, re.S) is not None

    found = sorted((r for r in rules if fits(r)), key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    return host, path, found[0].name if found else None, found[0].verdict if found else default


def run(spark, urls, rules, **options):
    rows = [(i, u, "h") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({})
    for c in CLASHING:
        df = df.selectExpr("*", f"'x' as {c}")
    return {r["page_id"]: tuple(r)[1:] for r in url_verdicts(df, rules, **options).collect()}


def test_query_rules_against_brute_force(spark):
    got = run(spark, URLS, QUERY_RULES)
    assert got == {i: brute(u, QUERY_RULES) for i, u in enumerate(URLS)}


def random_rules(rng, n):
    labels, ends = ["a", "b", "shop", "x1", "é", "-"], ["com", "net", "co.uk"]
    paths = ["/", "/en/", "/a*z/", "/a/b", "/é/", "", "/*/q/", "/en"]
    return [
        Rule(".".join([*rng.choices(labels, k=rng.randrange(3)), rng.choice(ends)]), rng.choice(paths), rng.choice(["allow", "block"]))
        for _ in range(n)
    ]


def test_index_loses_no_rule(spark):
    rng = random.Random(4)
    rules = random_rules(rng, 150)
    urls = []
    for _ in range(400):
        r = rng.choice(rules)
        path = r.path.replace("*", rng.choice(["", "q", "/q/"])) + rng.choice(["", "x", "/q/", "?en"])
        urls.append(f"http://{rng.choice(['', 'm.', 'x', 'a.b.'])}{r.host}{path}")
    expected = {i: brute(u, rules) for i, u in enumerate(urls)}
    assert run(spark, urls, rules) == expected
    # The same in many blocks.
    assert run(spark, urls, rules, max_bytes=2000) == expected


def test_rules_lie_under_their_rarest_token():
    rule = Rule("news.example.com", "/sport/live", "block")
    index = RuleIndex([rule], {"news": 50, "example": 90, "com": 100, "sport": 3})
    assert list(index.by_token) == ["sport"]
    # The last token of a path prefix may go on in the URL and is no literal.
    assert "live" not in rule.literals()


def test_no_rules_and_empty_table(spark):
    assert all(v[2:] == (None, "block") for v in run(spark, URLS, [], default="block").values())
    assert run(spark, [], QUERY_RULES) == {}


def test_rule_hosts_in_upper_case_fit():
    assert Rule("Example.COM", "/A", "block") == Rule("example.com", "/A", "block")
