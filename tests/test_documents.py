import json

from pyspark.sql import functions as F

from stormledger.operators import documents


def payloads(spark, *docs):
    rows = [(k, d if isinstance(d, str) or d is None else json.dumps(d)) for k, d in enumerate(docs)]
    return spark.createDataFrame(rows, "id long, payload string")


def facts(spark, *docs):
    return [r.asDict() for r in documents.payload_facts(payloads(spark, *docs), "id").orderBy("id").collect()]


def test_objects_come_in_order_of_the_document(spark):
    doc = {"z": {"b": 1, "a": [{"q": "x"}, [{"r": None}], 5, {"s": {"t": True}}]}, "a": "1, {2}", "m": {}}
    rows = sorted(documents.objects(payloads(spark, doc), "id").collect(), key=lambda r: r.at)
    assert [[f.name for f in r.fields] for r in rows] == [["z", "a", "m"], ["b", "a"], ["q"], ["r"], ["s"], ["t"], []]
    assert [r.via for r in rows] == [None, "z", "a", None, "a", "s", "m"]
    assert [(f.text, f.kind) for r in rows for f in r.fields if f.kind not in "{["] == [("1, {2}", '"'), ("1", "0"), ("x", '"'), (None, "n"), ("true", "b")]


def test_people_by_name_and_by_value(spark):
    direct = {"modelname": "WF", "datums": [{"datum": [{"datasource": "POP", "POPAFFECTED": "1,234", "SUMPOP1.0": "2,000", "SUMPOP2.0": "3,000", "SUMPOP5.0": "5,000", "SUMPOP10.0": "9,000"}, {"datasource": "other", "SUMPOP0": 7}]}]}
    beside = {"datums": [{"datum": [{"datasource": "POP", "scalars": [{"name": "POPAFFECTED", "value": "42"}, {"name": "SUMPOP5.0", "value": "101"}]}]}]}
    order = {"later": {"sumpop1": 3}, "scalars": [{"key": "sumpop1", "amount": 1}, {"SUMPOP2": "n/a", "name": "SUMPOP2", "value": None, "count": 8}], "SUMPOP5": -1, "SUMPOP-5.0": 6.5, "SUMPOP10": False}
    no_fallback = {"data_source": "pop", "x": 1, "y": [{"POPAFFECTED": 5}], "SUMPOP5": None}
    outside = [{"datasource": "POP"}, {"POPAFFECTED": 5}]
    a, b, c, d, e = facts(spark, direct, beside, order, no_fallback, outside)
    people = lambda r: tuple(r[n] for n in documents.PEOPLE)
    assert people(a) == (1234, 2000, 3000, 5000, 9000) and a["model_name"] == "WF"
    assert people(b) == (42, None, None, 101, None)
    assert people(c) == (None, 3, 8, 6, 0)
    assert people(d) == (5, None, None, None, None) and people(e) == (None,) * 5


def test_the_best_advisory(spark):
    item = lambda i, actual, current, at, pop, **more: {"id": i, "actual": actual, "current": current, "advisory_datetime": at, "pop": "999", "pop39": pop} | more
    steps = [item("a", "True", "false", "25 Jul 2026 18:00", "100"), item("b", "True", "true", "26 Jul 2026 00:00", "200", pop74="20", popstormsurge="5"), item("c", "False", "false", "27 Jul 2026 00:00", "300")]
    late = [item("a", "yes", None, "2026-07-25T18:00:00Z", 1), item("b", "1", "0", "2026-07-25T20:30:00+01:00", 2), item("c", True, "no", "2026-07-25T19:30:00+0000", 3), item("d", "y", "", "soon", 4)]
    loose = {"x": {"pop74": 3, "id": "l"}, "y": {"item": {"id": "none"}}}
    a, b, c, d = facts(spark, {"channel": {"item": steps}}, {"item": late}, loose, {"item": steps[0], "list": [{"pop39": 7, "current": "true", "actual": "true"}]})
    assert (a["advisory"], a["population_wind_39kt"], a["population_wind_74kt"], a["population_storm_surge"], a["advisory_actual"], a["advisory_current"]) == ("b", 200, 20, 5, True, True)
    assert (b["advisory"], b["population_wind_39kt"]) == ("b", 2)  # as late as c, and before it
    assert (c["advisory"], c["population_wind_74kt"], c["advisory_actual"]) == ("l", 3, False)
    assert d["population_wind_39kt"] == 100  # a listed step comes before any other


def test_payloads_that_tell_nothing(spark):
    rows = facts(spark, None, "", "[1, 2", "7", '"text"', "[]", {"episodeid": "x", "a": [{"episode": 3}, {"episode_id": "12"}, {"episode": 12.9}]}, '{"a": 1, "a": 2}')
    assert len(rows) == 8 and all(v is None for r in rows[:6] + rows[7:] for n, v in r.items() if n != "id")
    assert rows[6]["latest_episode"] == 12
    assert documents.payload_facts(payloads(spark, None).where("false"), "id").count() == 0


def episode(spark, *asked):
    rows = [(k, json.dumps(d), n) for k, (d, n) in enumerate(asked)]
    df = spark.createDataFrame(rows, "id long, payload string, n long")
    return [r.asDict() for r in documents.payload_episodes(df, "id", "n").orderBy("id").collect()]


def test_metrics_of_the_episode_that_is_asked_for(spark):
    of = lambda n, ha, last: {"episodeid": n, "severitydata": {"severitytext": f"Green impact for forestfire in {ha} ha"}, "fromdate": "2026-08-27T00:00:00", "todate": f"{last}T00:00:00"}
    both = {"properties": {"episodes": [of(9, 15813, "2026-09-04"), of(10, 16194, "2026-09-05")]}}
    explicit = {"episodeid": 11, "ha": "16,250", "severitydata": {"severitytext": "Green impact for forestfire in 16194 ha"}}
    unnamed = {"severitydata": {"severitytext": "Green impact for forestfire in 12,345 ha"}, "fromDate": "2026-08-01", "toDate": "2026-08-06"}
    nested = {"episodeid": "3", "x": {"episode": 3, "Days": "4", "hectares": 5}, "startdate": "3 March 2024", "y": [{"episode": 4, "enddate": "2024/3/9"}]}
    a, b, c, d, e, f = episode(spark, (both, 10), (both, 9), (explicit, 11), (unnamed, 7), (nested, 3), (nested, None))
    assert (a["burned_area_ha"], a["start_date"], a["last_detection"], a["duration_days"], a["duration_field"]) == (16194.0, "2026-08-27", "2026-09-05", 9, "derived")
    assert (b["burned_area_ha"], b["area_field"], b["last_detection"]) == (15813.0, "severitytext", "2026-09-04")
    assert (c["burned_area_ha"], c["area_field"]) == (16250.0, "ha")
    assert (d["burned_area_ha"], d["duration_days"]) == (12345.0, 5)
    assert (e["burned_area_ha"], e["start_date"], e["last_detection"], e["duration_days"], e["duration_field"]) == (5.0, "2024-03-03", "2024-03-09", 4, "Days")
    assert f["duration_days"] == 4


def test_content_ignores_order_and_volatile_fields_at_any_depth(spark):
    base = {"id": "e", "at": {"lat": 1.00000000001, "checked_at": "x"}, "members": [{"id": "b", "v": [1, 2]}, {"id": "a", "deep": {"footprint": 1, "k": None}}], "tags": ["p", "q"], "none": []}
    same = {"none": [], "tags": ["p", "q"], "members": [{"deep": {"k": None}, "id": "a"}, {"v": [1, 2], "id": "b", "last_seen": 9}], "at": {"lat": 1.0}, "id": "e", "generated_at": "now"}
    others = [base | {"tags": ["q", "p"]}, base | {"members": base["members"][:1]}, base | {"none": {}}, base | {"at": {"lat": "1.0"}}, base | {"members": [{"id": "b", "v": [2, 1]}, base["members"][1]]}, base | {"extra": None}, {}]
    rows = [r.row for r in documents.content(payloads(spark, base, same, *others, None), "id", ("checked_at", "footprint", "last_seen", "generated_at")).orderBy("id").collect()]
    assert rows[0] == rows[1] and rows[-1] is None
    assert len({tuple(r) for r in rows[:-1]}) == len(rows) - 2


def test_the_walk_stays_in_the_jvm(spark):
    df = documents.payload_facts(payloads(spark, {"a": [{"b": 1}]}), "id")
    assert not any(word in df._jdf.queryExecution().toString() for word in ("Python", "InPandas", "InArrow"))
    assert df.select(F.count("*")).first()[0] == 1
