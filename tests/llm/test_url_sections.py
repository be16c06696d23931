"""Small sections of large hosts and deep paths keep their own templates."""

from demospan.llm import url_filter as U


def verdicts(spark, urls, bad):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(bad(u))) for i, u in enumerate(urls)], "page_id bigint, bad int")
    return {urls[r.page_id]: (r.template, r.verdict) for r in U.judged(pages, labels, {}).collect()}


def test_small_bad_section_of_a_large_host(spark):
    urls = [f"http://hot.net/s{chr(97 + i % 26)}{chr(97 + i // 26 % 4)}/{i}" for i in range(2080)]
    urls += [f"http://hot.net/junk/{i}" for i in range(20)]  # under 1 in 50, and 105 sections in all
    got = verdicts(spark, urls, lambda u: "/junk/" in u)
    assert {got[u] for u in urls[2080:]} == {("/junk/<n>", "block")}
    assert {got[u] for u in urls[:2080]} == {("/*/<n>", "allow")}


def test_few_labels_are_no_evidence_for_a_rare_section(spark):
    urls = [f"http://hot.net/s{chr(97 + i % 26)}{chr(97 + i // 26 % 4)}/{i}" for i in range(2080)] + ["http://hot.net/junk/1"]
    assert verdicts(spark, urls, lambda u: "/junk/" in u)[urls[-1]] == ("/*/<n>", "allow")


def test_paths_differ_below_the_eighth_level(spark):
    deep = "http://deep.net/" + "/".join("abcdefghi")
    urls = [f"{deep}/{name}/{i}" for name in ("good", "bad") for i in range(40)] + ["http://long.net/" + "/".join(["x"] * 3000)]
    got = verdicts(spark, urls, lambda u: "/bad/" in u)
    assert got[f"{deep}/bad/7"] == ("/a/b/c/d/e/f/g/h/i/bad/<n>", "block")
    assert got[urls[-1]][0] == "/x" * 3000
    assert got[f"{deep}/good/7"] == ("/a/b/c/d/e/f/g/h/i/good/<n>", "allow")
