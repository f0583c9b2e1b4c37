"""capture_no counts a URL's whole history, however many partitions it lies in."""

from laminar.llm import warc


def test_capture_numbers_of_a_hot_url(spark):
    rows = [(k, "http://hot.example.com/" if k % 3 else f"http://h{k % 7}.example.com/{k % 2}", f"<p>{k}</p>") for k in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want, seen = {}, {}
    for i, url, _ in rows:  # ids are in the order of time
        want[i] = seen[url] = seen.get(url, 0) + 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("8", "29", "1"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            parts = warc.capture_histories(pages).rdd.glom().collect()
            assert {r["page_id"]: r["capture_no"] for p in parts for r in p} == want
            keys = [(r["url_key"], r["date"]) for p in parts for r in p]
            assert keys == sorted(keys) and len(keys) == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
