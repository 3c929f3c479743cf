import random

from plumbline.llm import url_filters as U
from plumbline.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, text in sorted(set(rules), key=lambda r: (-len(r[1]), r[1])):
        rule_host, rule_path = text[: text.index("/")], text[text.index("/") :]
        fits = host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path)
        if fits and best is None:
            best = (text, verdict)
    return host, path, *(best or (None, default))


def check(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, U.rules_table(spark, rules)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_edges(spark):
    urls = [None, "", "no scheme", "http://", "http://NET", "http://net/", "http://a.net?x", "http://a.net/?x#y", "http://anet/", "https://WWW.example.com/de/x", "http://example.net/en/", "http://example.net/en", "http://x.org/fr/?a://b/c", "http://a.net/en/", "http://Ä.org/fr/", "http://a..net/b", "http://net./b", "http://x.net/" + "p" * 50_000]
    check(spark, urls * 2, URL_RULES)


def test_random_nested_rules(spark):
    rng = random.Random(5)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rules = [(rng.choice(["block", "allow"]), rng.choice(hosts) + "/" + rng.choice(["", "x/", "x/y", "z"])) for _ in range(30)]
    rules = list({text: (v, text) for v, text in rules}.values())
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['', 'x', 'x/', 'x/y/z', 'zz'])}" for _ in range(400)]
    check(spark, urls, rules)


def test_many_rules_of_one_host(spark):
    rng = random.Random(7)
    paths = sorted({"/" + "/".join(rng.choice("abcd") for _ in range(rng.randint(0, 6))) for _ in range(400)})
    rules = [(rng.choice(["block", "allow"]), "com" + p) for p in paths] + [("block", "a.com/a/b"), ("allow", "b.a.com/")]
    urls = [f"http://{rng.choice(['', 'a.', 'b.a.', 'x.b.a.'])}com{rng.choice(paths)}{rng.choice(['', '/', 'z'])}" for _ in range(300)]
    check(spark, urls, rules)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string, host string, rule int")
    assert U.judge_urls(none, U.rules_table(spark, URL_RULES)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/", "old", 3)], "page_id long, url string, host string, open int")
    row = U.judge_urls(pages, U.rules_table(spark, URL_RULES)).first()
    assert (row.host, row.rule, row.open) == ("a.net", "net/", 3)
    assert U.judge_urls(pages, spark.createDataFrame([], U.RULES_SCHEMA)).first().verdict == "allow"
