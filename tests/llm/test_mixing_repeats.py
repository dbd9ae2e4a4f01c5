from pointloom.llm import mixing


def test_equal_rows_meet_the_target(spark):
    rows = [(7, "one two three four five six seven eight nine ten", "a")] * 1000 + [(i, f"word {i} " * 5, "b") for i in range(400)] + [(None, "no id at all", None)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for source in ("a", "b", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    again = mixing.mix(df).collect()
    key = lambda rs: sorted((r["source"] or "", r["doc_id"] or -1, r["copies"]) for r in rs)
    assert key(again) == key(got)
