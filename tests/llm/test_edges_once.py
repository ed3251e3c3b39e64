from targetloom.llm import prefix_orders


def test_components_read_written_edges(spark, monkeypatch):
    """Components read their edges twice; edges that are not written would be computed twice, shuffles included."""
    plans, labels = [], prefix_orders.component_labels

    def seen(edges):
        plans.append(edges._jdf.queryExecution().toString())
        return labels(edges)

    monkeypatch.setattr(prefix_orders, "component_labels", seen)
    words = [f"w{i}" for i in range(60)]
    # copies that differ in one word, more of them than a block holds
    docs = spark.createDataFrame([(i, " ".join(words[:59] + [f"x{i}"])) for i in range(12)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in prefix_orders.near_components(docs, block=4).collect()}
    assert got == dict.fromkeys(range(12), 0)
    assert plans and not [p for p in plans if "MapInArrow" in p]


def test_texts_that_nobody_asks_for_are_dropped_before_the_join(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 7 <> 0 THEN id END AS doc_id")
    asked = spark.range(0, 20_000, 50).selectExpr("CASE WHEN id % 7 <> 0 THEN id END AS a_id").distinct()
    kept = [r.doc_id for r in prefix_orders._perhaps_asked(rows, asked).collect()]
    assert {r.a_id for r in asked.collect()} <= set(kept)
    assert len([k for k in kept if k is not None]) < 600
