"""Quality rules against SQL and by hand; URL rules and trees."""

import pytest
from conftest import SF001, SF01
from oracle import connect, difference

from strandline.llm import queries, rules, urls


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_rules_equal_sql(spark, folder):
    assert not difference(spark, connect(folder), queries.op9_rules, queries.ORACLE_SQL["op9_rules"], folder)


def by_hand(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n ", "a", "a a a a", "a b c a b c x", "a b a b a b a", "<<##>> é", "l\nl\n l\nl", "\x0b\x0cw\r\nw\r\n", "x y z " * 20_000, "w" * 100_000, "1 2 3 4 5 6 1 2 3 9 4 5 6"]


def test_base_rules(spark):
    rows = spark.createDataFrame([(i, t, "s", 1, "k") for i, t in enumerate(TEXTS)] + [(3, "a", "s", 1, "k")], "doc_id long, text string, source string, kept int, words string")
    got = {r.doc_id: tuple(r)[2:7] for r in rules.base_rules(rows).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(TEXTS)}


def test_frequent_lines_deplete(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    boiler = "This line is on every page of the site"
    rows = [(i, f"{own(i)}\n{boiler.upper()}  \n", "h") for i in range(20)]
    rows += [(50, "\n".join([boiler] * 9), "h"), (51, "\n".join([boiler, own(51)]), "other"), (52, own(52), None), (53, None, None)]
    rows += [(60 + i, own(99), "h") for i in range(30)]  # copies of one text count once
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert len(got) == len(rows) and not got[50].kept and not got[53].kept
    assert all(got[i].kept and got[i].gone == [1] for i in range(20)) and got[51].kept and got[51].gone is None and got[60].kept
    clean = {r.doc_id: r.text for r in rules.clean(docs).collect()}
    assert clean[3] == f"{own(3)}\n" and clean[51] == rows[21][1] and set(clean) == {i for i, r in got.items() if r.kept}
    assert rules.judge(docs.limit(0)).count() == 0 and rules.clean(docs.limit(0)).columns == docs.columns


def test_long_lines_count(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    licence = " ".join(f"term{k}" for k in range(41))
    rows = [(i, f"{own(i)}\n{licence}", "h") for i in range(10)] + [(20, "\n".join([licence] * 2 + ["some own words"]), "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert all(got[i].kept and got[i].gone == [1] and got[i].gone_words == 41 for i in range(10))
    assert got[20].depleted and not got[20].kept
    assert {r.doc_id: r.text for r in rules.clean(docs).collect()} == {i: own(i) for i in range(10)}


@pytest.mark.parametrize("url, host, path, rule", [
    ("http://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"), ("x://b.net/fr/1", "b.net", "/fr/1", "net/fr/"),
    ("x://net/es/", "net", "/es/", "net/es/"), ("x://notnet/es/", "notnet", "/es/", None), ("http://e.com?x", "e.com", "", None), ("no scheme", "", "", None), (None, "", "", None), ("a://b://c/d", "b:", "//c/d", None),
    ("http://É.com/", "É.com", "/", "com/"), ("h\n://q.com/a\nb?c", "q.com", "/a\nb", "com/"), ("http://x.com/" + "a" * 50_000, "x.com", "/" + "a" * 50_000, "com/"),
])
def test_url_parts_and_rules(spark, url, host, path, rule):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(url,)], "url string").select(urls.host_of(F.col("url")).alias("h"), urls.path_of(F.col("url")).alias("p"))
    row = row.select("h", "p", urls.rule_of(F.col("h"), F.col("p"), queries.URL_RULES, "rule").alias("r"), urls.rule_of(F.col("h"), F.col("p"), queries.URL_RULES, "verdict").alias("v")).first()
    assert (row.h, row.p, row.r) == (host, path, rule)
    assert row.v == (None if rule is None else queries.URL_RULES[rule])


def test_trees_learn_and_are_native(spark):
    rows = [(i, f"http://site{i}.org/a/{i}" if i % 2 else f"http://cheap-{i}-pills.org/x{i}?q={i}&z=1", i % 2 == 0) for i in range(300)]
    labelled = spark.createDataFrame([(u, int(b)) for _, u, b in rows], "url string, label int")
    pages = spark.createDataFrame([(i, u, "other") for i, u, _ in rows] + [(900, None, "n"), (901, "", "n"), (901, "", "n")], "page_id long, url string, score string")
    out = urls.judge(pages, {}, labelled)
    got = {r.page_id: r.verdict for r in out.collect()}
    assert sum((got[i] == "block") == b for i, _, b in rows) > 290 and out.count() == 303
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
    assert {r.score for r in urls.judge(pages, {}, labelled.limit(0)).collect()} == {0.5}
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_a_repeated_url_does_not_fill_the_sample(spark):
    rows = [("http://hot.org/a", 0)] * 500 + [(f"http://cheap-{i}-pills.org/x?q={i}&z=1", 1) for i in range(60)] + [(f"http://site.org/a/{i}", 0) for i in range(60)]
    model = urls.fit(spark.createDataFrame(rows, "url string, label int"), sample=50)
    pages = spark.createDataFrame([("http://cheap-999-pills.org/x?q=1&z=1",), ("http://site.org/a/77",)], "url string")
    bad, good = [r.score for r in model.score(urls.features(pages)).collect()]
    assert bad > 0.7 > 0.3 > good


def test_entropy(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("abcd",)], "t string")
    assert [round(r[0], 6) for r in rows.select(urls.entropy(F.col("t"))).collect()] == [0, 0, 1, 2]
