from quire.operators.removal import removed_texts


def test_removal(spark):
    blocks = spark.createDataFrame([("d", 0, "body", "The first paragraph is translated here.", 0, 10.0, 0.0), ("d", 0, "data", "Table cell 42", 0, 50.0, 0.0)], "doc_id string, page int, type string, text string, col int, top double, x0 double")
    ops = [("BT", ""), ("Tj", "The first para"), ("Tj", "graph is trans"), ("Tj", "•"), ("Tj", "lated here."), ("Tj", "slides along"), ("Td", ""), ("Tj", "Table cell 42"), ("ET", "")]
    df = spark.createDataFrame([("d", 0, i, o, t) for i, (o, t) in enumerate(ops)], "doc_id string, page int, seq int, op string, text string")
    got = {r.seq: (r.dropped, r.displaced) for r in removed_texts(df, blocks).collect()}
    assert [i for i in got if got[i][0]] and {i for i in got if got[i][0]} == {1, 2, 3, 4}
    assert {i for i in got if got[i][1]} == {5}
