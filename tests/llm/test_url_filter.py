import random

from quern.llm import url_filter as uf


def test_against_brute_force(spark):
    rng = random.Random(2)
    pages = [(None, None), (1, ""), (2, "no host"), (3, "HTTPS://Www.Example.NET"), (4, "http://a.net/en/"), (5, "http://example.net/en/5?q#x"), (6, "http://notexample.net/en/1"), (7, "x://org/fr/9#"), (8, "a://b://c/d"), (9, "http://h.io/ü/\n/x?y"), (10, "http://h.io//"), (11, "http://net")]
    for i in range(100, 1400):
        host = rng.choice(["shop.io", "shop.io", "News.Example.com", "x.org"])
        path = rng.choice([f"/p/{i}", f"/u{rng.choice('abcdefgh')}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}/post", "/de/1.html", "/spam/buy/now/at/once", "/en/a/b/c/d/e/f", "/fr/"])
        pages.append((i, f"http://{host}{path}"))
    labels = [(i, "spam" in u or rng.random() < 0.1) for i, u in pages if i and i > 99 and rng.random() < 0.6] + [(101, None), (102, True), (102, False), (None, True)]
    pages += pages[20:25]
    got = uf.judge(spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, host string, bad string"), spark.createDataFrame(labels, "page_id long, bad boolean"))
    got = [tuple(r)[:5] for r in got.collect()]
    want = uf.brute_force(pages, labels)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[4] for r in want if r[2].startswith("/spam/") and not r[3]} == {"block"} and any(r[4] == "allow" for r in want)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge(empty, spark.createDataFrame([], "page_id long, bad boolean")).count() == 0
    one = spark.createDataFrame([(1, "http://a.io/b")], "page_id long, url string")
    assert [r.verdict for r in uf.judge(one, spark.createDataFrame([], "page_id long, bad boolean")).collect()] == ["allow"]


def test_very_long_urls(spark):
    """A path of many segments, and one of a megabyte."""
    pages = [(1, "http://a.io/" + "x/" * 3_000), (2, "http://a.io/" + "y" * 1_000_000 + "?q"), (3, "http://a.io/" + "x/" * 3_000), (4, "http://" + "h." * 50_000 + "net/z")]
    labels = [(1, True), (3, True), (2, False), (4, None)]
    assert compared(spark, pages, labels)[1][4] == "block"
    long = [(k, f"http://a.io/{'x/' * 100_000}{k}/{letters(k)}") for k in range(3)]
    got = uf.judge(spark.createDataFrame(long, "page_id long, url string"), spark.createDataFrame([(0, True)], "page_id long, bad boolean")).collect()
    assert {len(r.path) for r in got} == {len(f"/{'x/' * 100_000}1/{letters(1)}")}


def letters(k):
    return "".join(chr(97 + k // 26**i % 26) for i in range(3))


def compared(spark, pages, labels):
    got = uf.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"))
    want = uf.brute_force(pages, labels)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    return {r[0]: r for r in want}


def test_wildcards_deep_in_the_tree(spark):
    """Below what many urls share, below a wildcard, and in paths that go on ever deeper."""
    common = "/".join(f"s{letters(k)}" for k in range(60))
    pages = [(k, f"http://a.io/{common}/{letters(k)}/{'buy' if k % 2 else 'read'}/now") for k in range(120)]
    pages += [(1000 + k, f"http://b.io{'/' + letters(7) * (k > 40)}{'/deeper' * k}") for k in range(70)]
    pages += [(2000 + k, f"http://b.io/{letters(k // 30)}/{letters(k)}/{letters(k * 7 % 40)}") for k in range(1500)]
    labels = [(k, k % 2 == 1) for k in range(80)] + [(2000 + k, k % 30 == 4) for k in range(0, 1500, 3)]
    want = compared(spark, pages, labels)
    # the wildcard joins what the labels saw and what they did not
    assert {want[k][4] for k in range(81, 120, 2)} == {"block"} and {want[k][4] for k in range(80, 120, 2)} == {"allow"}


def test_joins_beyond_the_bound_of_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(uf, "BROADCAST_BYTES", 0)
    pages = [(k % 600, f"http://a.io/{letters(k % 5)}/{'bad' if k % 3 else 'good'}") for k in range(900)] + [(None, None)]
    want = compared(spark, pages, [(k, k % 3 > 0) for k in range(0, 600, 2)])
    assert want[1][4] == "block" and want[3][4] == "allow"


def test_branches_are_held_against_all_other_siblings(spark):
    """Shares that rise in small steps are no single branch: the worst are apart from the middle."""
    pages, labels = [], []
    for t in range(11):
        for k in range(60):
            pages.append((len(pages), f"http://a.io/{letters(t)}"))
            labels.append((len(labels), k < 6 * t))
    want = compared(spark, pages, labels)
    assert {want[t * 60][4] for t in (9, 10)} == {"block"} and {want[t * 60][4] for t in (0, 1)} == {"allow"}


PLAIN, LISTED, LINKS = "<p>" + "plain words of a page " * 8, "one | two | three | " * 9, '<a href="/x">go</a> ' * 7


def test_labels_from_pages(spark):
    rows = [(1, "http://casino.io/x", PLAIN), (2, "http://a.io/x", LISTED), (3, "http://a.io/y", "word### " * 11), (4, "http://a.io/z", LINKS), (5, "http://a.io/z", None), (6, None, ""), (7, None, PLAIN + "<script>" + "#|" * 500), (8, None, f"{PLAIN}<STYLE>{LISTED}</style>{PLAIN}<!--{LISTED}"), (9, None, "<" * 100_000 + "<!--" * 100_000)]
    got = {r.page_id: r.bad for r in uf.page_labels(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: None, 6: None, 7: False, 8: False, 9: False}


def test_templates_foretell_pages_that_the_labels_have_not_seen(spark, tmp_path):
    """The query against its SQL and held-out pages, where some templates do hold bad pages."""
    import duckdb

    rng = random.Random(4)
    rows = [(None, None, None), (5000, "http://h.io/a", None), (5001, "http://h.io/a", "")]
    for k in range(1500):
        kind = rng.choice(["tags", "posts", "go"])
        bad = rng.random() < {"tags": 0.9, "posts": 0.02, "go": 0.8}[kind]
        rows.append((k, f"http://{rng.choice(['h.io', 'www.h.io', 'k.org'])}/{kind}/{letters(k)}/{k}", rng.choice([LISTED, LINKS]) if bad else PLAIN))
    spark.createDataFrame(rows + rows[9:12], "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    found = uf.op9_url_filter(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(con.sql(uf.ORACLE_SQL).fetchall(), key=str)
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet").dropDuplicates()
    n = {(r.verdict, r.bad): r.n for r in uf.agreement(found.dropDuplicates(), uf.page_labels(pages)).collect()}
    assert n["block", True] > 100 and n["block", True] > 4 * n.get(("block", False), 0) and n["allow", False] > 20 * n.get(("allow", True), 0)
