import duckdb

from checks.run import compare
from patronage.llm import urls

URLS = [
    None, "", "no scheme/path", "http://", "http://Example.ORG", "http://a.example.org/", "http://a.example.org/es/1", "http://xexample.org/es/1",
    "https://a.example.org/en/12?x=/es/", "https://a.example.org/en/21#top", "http://org/", "http://.org/x", "http://a.com/de", "http://a.com/de/", "http://a.com/fr/9",
    "http://a.com?x://b.org/", "ftp://B.NET:80/a/b/c/d/e", "http://net.org.evil/es/", "x://y://z.org/", "http://É.org/ä", "http://a.org//double//slash/", "http://h.com/de/0123456789abcdef0/x",
    "http://a.com\n/fr/", "://com/fr/", " http://sp.org/", "http://user@a.org/",
]


def table(spark, rows):
    return spark.createDataFrame([(i, u, "<p>", "r", 1) for i, u in rows], "page_id long, url string, html string, rule string, n int")


def test_odd_urls_as_in_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    rows = [*enumerate(URLS), (None, "http://a.org/"), (3, "http://"), (3, "http://")]
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert compare(urls.filter_urls(table(spark, rows)), con, urls.SQL) is None


def test_hosts_rules_and_verdicts(spark):
    got = {URLS[r["page_id"]]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(table(spark, enumerate(URLS))).collect()}
    assert got[None] == got[""] == got["no scheme/path"] == ("", "", None, "allow")
    assert got["http://Example.ORG"] == ("example.org", "", None, "allow")
    assert got["http://a.example.org/"] == ("a.example.org", "/", "org/", "allow")
    assert got["http://a.example.org/es/1"][2:] == ("example.org/es/", "block")
    assert got["http://xexample.org/es/1"][2:] == ("org/", "allow")
    assert got["https://a.example.org/en/12?x=/es/"] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got["https://a.example.org/en/21#top"][2:] == ("org/", "allow")
    assert got["http://a.com/de/"][2:] == ("com/de/", "block") and got["http://a.com/fr/9"][2:] == ("com/fr/", "allow")
    assert got["http://a.com?x://b.org/"][:2] == ("a.com", "") and got["x://y://z.org/"][:2] == ("y:", "//z.org/")
    assert got["http://É.org/ä"][:2] == ("É.org", "/ä")


def test_empty_table(spark):
    assert urls.filter_urls(table(spark, [])).count() == 0


def test_similar_branches_merge_and_impure_templates_go(spark):
    rules = (("block", "h.com", "/spam/"), ("block", "h.com", "/junk/"), ("allow", "h.com", "/good/"), ("block", "v.net", "/a/"), ("block", "v.net", "/b/"))
    names = [f"http://h.com/{s}/{i}.html" for s in ("spam", "junk", "good", "new") for i in range(40)]
    names += [f"http://v.net/{s}/{i}/" for s in "abc" for i in range(100, 200)] + ["http://w.net/c/1/"]
    by = {names[r["page_id"]]: r for r in urls.filter_urls(table(spark, enumerate(names)), rules).collect()}
    # the good branch stands apart from its siblings, and so they from it; the new one has no evidence
    assert by["http://h.com/good/1.html"]["template"].startswith("h.com/good/")
    assert by["http://h.com/spam/1.html"]["template"].startswith("h.com/spam/")
    assert (by["http://h.com/new/1.html"]["verdict"], by["http://h.com/new/1.html"]["rule"]) == ("allow", None)
    # branches a and b are alike and merge with c, which falls with them
    c = by["http://v.net/c/150/"]
    assert (c["rule"], c["template"], c["labelled"], c["blocked"], c["verdict"]) == (None, "v.net/*/{num}//$", 200, 200, "block")
    assert by["http://w.net/c/1/"]["verdict"] == "allow"


def both(spark, names, rules):
    """The rows by url, after a comparison with the SQL of these rules."""
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(names)))
    got = urls.filter_urls(table(spark, enumerate(names)), rules)
    assert compare(got, con, urls._sql(rules)) is None
    return {names[r["page_id"]]: r for r in got.collect()}


def test_a_rare_labelled_branch_of_a_hot_host_stands_alone(spark):
    count = {"en": 9000, "fr": 950, "de": 50}
    by = both(spark, [f"http://h.com/{s}/{i}" for s, n in count.items() for i in range(n)], urls.RULES)
    assert {r["verdict"] for u, r in by.items() if "/en/" in u} == {"allow"}
    assert by["http://h.com/de/7"]["template"] == "h.com/de/{num}/$" and by["http://h.com/de/7"]["blocked"] == 50
    assert (by["http://h.com/en/7"]["labelled"], by["http://h.com/en/7"]["rule"]) == (0, None)


def test_branches_far_down_are_told_apart(spark):
    deep = "/".join("abcdefghijklmnopqrstuvwxyz" * 20)
    rules = (("block", "h.com", f"/{deep}/bad/"), ("allow", "h.com", f"/{deep}/fine/"), ("block", "h.com", f"/{deep}/new/x/y/1"))
    names = [f"http://h.com/{deep}/{s}/{t}/{i}" for s in ("bad", "fine") for t in "pq" for i in range(10)]
    names += [f"http://h.com/{deep}/new/x/{s}/{i}" for s in "yz" for i in range(30)] + ["http://h.com/", "http://h.com"]
    by = both(spark, names, rules)
    assert by[f"http://h.com/{deep}/bad/p/1"]["template"].startswith(f"h.com/{deep}/bad/")
    assert by[f"http://h.com/{deep}/new/x/z/3"]["verdict"] == "allow"
    assert by[f"http://h.com/{deep}/new/x/y/2"]["rule"] is None
