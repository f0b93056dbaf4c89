from pyspark.sql import functions as F

from millrace.sources.summaries import page_summary

LONG = "A second paragraph that is quite long enough to tell what the story is about, really."


def test_order_repeats_and_cuts(spark):
    dek = '<p class="standfirst">' + "The standfirst tells the story in one good sentence." + "</p>"
    rows = [
        (f"<article>{dek}<p>{LONG}</p></article>", "Quite another title", None), (f'<meta name="description" content="{LONG}"><p>By someone who wrote this long byline for it</p>', "Quite another title", None),
        (f'<meta name="description" content="{LONG}"><article><p>{LONG[:60]} and then something else follows</p></article>', "Quite another title", LONG), ("<p>short</p>", "Quite another title", None),
        ("<main><p>" + "word " * 100 + "</p></main>", "Quite another title", None), (None, None, None),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, "h string, t string, e string").select(page_summary(F.col("h"), F.col("t"), F.col("e"))).collect()]
    assert got[0].startswith("The standfirst") and got[1] == LONG and got[2] == LONG[:60].strip() + " and then something else follows"
    assert got[3] is None and got[4].endswith("word…") and len(got[4]) <= 321 and got[5] is None
