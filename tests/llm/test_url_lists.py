"""URL lists that are long, that clash, and what the filter lets through."""

from pyspark.sql import functions as F

from codebrook.llm import url_filter as u


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_a_list_longer_than_the_broadcast_and_the_filter(spark):
    """150,000 listed URLs, with a filter of full size and one of 64 blocks, which lets nearly all through."""
    listed = spark.range(150_000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example")).alias("host"), F.when(F.col("id") % 2 == 0, "/").otherwise("/a/").alias("path"), F.lit("block").alias("verdict"))
    urls = spark.range(3000).select(F.concat(F.when(F.col("id") % 3 == 0, "x.").otherwise(""), F.lit("h"), (F.col("id") * 100).cast("string"), F.lit(".example")).alias("host"), F.when(F.col("id") % 5 == 0, "/b").otherwise("/a/b").alias("path"))
    want = {r["host"] + r["path"] for r in urls.collect() if int(r["host"].split(".")[-2][1:]) < 150_000}
    entries = listed.select(F.concat("host", "path").alias("key"))
    passed = {}
    for most in (u.FILTER_BLOCKS, 64):
        got = u.listed_matches(urls, listed, most)
        assert {r["host"] + r["path"] for r in got.collect()} == want
        passed[most] = u.possible_keys(urls, entries, [1, 3], 150_000, most).count()
    assert len(want) <= passed[u.FILTER_BLOCKS] < 1.05 * len(want) and passed[64] > 3 * len(want)


def test_block_wins_a_clash_in_any_order(spark):
    for rows in ([("a.example", "/", "allow"), ("a.example", "/", "block")], [("a.example", "/", "block"), ("a.example", "/", "allow")]):
        got = u.judge(pages(spark, ["http://a.example/x"]), u.rule_table(spark, rows), u.rule_table(spark, []))
        assert got.first()["verdict"] == "block"


def test_listed_hosts_and_odd_urls(spark):
    urls = ["http://m.casino-win.example.com/x", "https://spam-farm.example.org:80/y", "http://user:pw@Pills.example./", "http://spammers.example/", "http://plain.example/casino", None, "casino.example", "http://sub.m.casino-win.example.com", "http://casino.example/" + "p" * 100_000]
    df = pages(spark, urls).withColumn("host", F.lit("clash")).withColumn("path", F.lit(1)).withColumn("key", F.lit(2))
    got = {r["page_id"]: r for r in u.judge(df, u.rule_table(spark, []), u.listed_hosts(df)).collect()}
    assert [got[k]["verdict"] for k in range(9)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "block", "block"]
    assert got[1]["host"] == "spam-farm.example.org:80" and got[2]["host"] == "user:pw@pills.example." and len(got[8]["path"]) == 100_001
    assert u.judge(df.limit(0), u.rule_table(spark), u.listed_hosts(df.limit(0))).count() == 0
