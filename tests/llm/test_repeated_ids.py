"""Ids that repeat must not multiply what is learned from; urls with an empty host are no aliases."""

from stratavox.llm import quality, toxicity, urlfilter


def test_an_id_is_learned_from_once(spark):
    rows = [(i, f"clean words number {i} and more words here") for i in range(20)] + [(i, f"vile scum number {i} and more scum here") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 20), int(i >= 20)) for i in range(40)], "doc_id long, toxic int, quality int")
    ids = quality.label_sample(labels, "doc_id", "quality", None, 1000)
    many = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(500)).select("doc_id", "text")).unionByName(spark.createDataFrame([(3, "another text")], "doc_id long, text string"))
    assert quality.one_text(many, ids, "doc_id", "text").count() == 40
    scores = lambda m: {r["doc_id"]: r["score"] for r in toxicity.tag(docs, m).collect()}
    plain = scores(toxicity.train(docs, labels))
    again = scores(toxicity.train(docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(500)).select("doc_id", "text")), labels))
    assert all(abs(plain[i] - again[i]) < 1e-6 for i in plain)
    long = spark.createDataFrame([(1, "scum " * 100)], "doc_id long, text string")
    assert toxicity.train(long, labels, most_chars=50).bias == 0


def test_urls_without_a_host_are_no_aliases(spark):
    link = '<link rel="canonical" href="https://example.net/x">'
    rows = [(1, "a:///x", link), (2, "b:///x", ""), (3, "https://example.net/x", ""), (4, "c://?q", link), (5, None, link)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["decided_by"]) for r in urlfilter.judge(pages).collect()}
    assert got == {1: ("allow", "default"), 2: ("allow", "default"), 3: ("block", "rule"), 4: ("allow", "default"), 5: ("allow", "default")}
