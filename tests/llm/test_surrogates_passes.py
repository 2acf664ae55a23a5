"""How often a text is searched."""

from treelens.llm import surrogates as s


def test_units_drawn_again_are_found_without_another_search_of_the_texts(spark, monkeypatch):
    ips = [f"{a}.{b}.{c}.{d}" for a in range(1, 6) for b in range(1, 6) for c in range(1, 6) for d in range(1, 6)]
    df = spark.createDataFrame([(i, f"<{ip}>") for i, ip in enumerate(ips)], "doc_id long, text string")
    plans, written = {}, s.written

    def seen(table, name):
        plans[name] = table._jdf.queryExecution().optimizedPlan().toString()
        return written(table, name)

    monkeypatch.setattr(s, "written", seen)
    got = {r.doc_id: r.text for r in s.replace(df, "k").collect()}
    assert len(set(got.values())) == len(ips) and not set(got.values()) & {f"<{ip}>" for ip in ips}
    assert "redrawn-texts" in plans
    assert [n for n, plan in plans.items() if "regexp_extract_all" in plan] == ["mentions"]
