"""Nested documents of unknown shape as rows, and facts found in them, without Python.

A document is opened level by level: a container's members become the next level's rows, so the number of rounds is
the depth of the deepest document, whatever their number. A row of `objects` is one object of a document with its fields
in order; `at`, the positions on the way to it, sorts the objects of a document so that each comes before what it holds.
Searches over a whole document are then minima by `at`, which combine before they are shuffled.

A payload that is null or no JSON has no objects; a document with an object that has a name twice counts as no JSON.
The key tells payloads apart; two rows of one key would be one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormledger.functions import parsing as P
from stormledger.operators.components import checkpointed

#: Names of the fields of each fact, as normalised keys (fixed values).
PEOPLE = {
    "population_burned_area": ("POPAFFECTED", "SUMPOP0.0", "SUMPOP0"),
    "population_within_1km": ("SUMPOP1.0", "SUMPOP1"),
    "population_within_2km": ("SUMPOP2.0", "SUMPOP2"),
    "population_within_5km": ("SUMPOP5.0", "SUMPOP5"),
    "population_within_10km": ("SUMPOP10.0", "SUMPOP10"),
}
NAMES, VALUES, EPISODES = ("name", "key", "scalar", "scalarname", "field", "metric"), ("value", "val", "amount", "count", "number"), ("episodeid", "episode_id", "episode")
WINDS = {"pop39": "population_wind_39kt", "pop74": "population_wind_74kt", "popstormsurge": "population_storm_surge"}
MODELS = {"modelrun": "model_run", "modelstatus": "model_status", "modelname": "model_name"}
AREA = ("HA", "HECTARES", "BURNEDAREA", "BURNEDAREAHA", "BURNEDAREAINHA", "AREAHA", "AREAINHA")
FROM, TO = ("FROMDATE", "STARTDATE", "EVENTSTARTDATE", "DATEFROM"), ("TODATE", "LASTDETECTION", "LASTDETECTIONDATE", "ENDDATE", "DATETO")
DURATION, AREA_TEXTS = ("DURATION", "DURATIONDAYS", "DAYS"), ("severitytext", "description", "title", "name")
DAY_FORMS = ("d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "d/M/yyyy")
ADVISORY_FORMS = ("d MMM yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssxx")


def kind_of(value: Column) -> Column:
    """What a variant is: { or [ for a container, " for a text, b, n (null) or 0 (a number)."""
    first = F.left(F.to_json(value), F.lit(1))
    return F.when(first.isin("{", "[", '"', "n"), first).when(first.isin("t", "f"), "b").otherwise("0")


def members(text: Column, kind: Column) -> Column:
    """array<struct<name, text, kind>> of a container: its fields or elements in order, texts without quotes."""

    def zipped(names: Column, texts: Column, values: Column) -> Column:
        return F.transform(F.arrays_zip(names.alias("n"), texts.alias("t"), values.alias("v")), lambda x: F.struct(x["n"].alias("name"), x["t"].alias("text"), kind_of(x["v"]).alias("kind")))

    fields, items = F.from_json(text, "map<string,string>"), F.from_json(text, "array<string>")
    no_name = F.transform(items, lambda _: F.lit(None).cast("string"))
    of_object = zipped(F.map_keys(fields), F.map_values(fields), F.map_values(F.from_json(text, "map<string,variant>")))
    return F.when(kind == "{", of_object).when(kind == "[", zipped(no_name, items, F.from_json(text, "array<variant>")))


def opened(payloads: DataFrame, key: str, inside=None, scope=None) -> DataFrame:
    """Every container of each payload: key, at, path (names and places), via, holder, scopes, kind and members.

    via: the field that holds this object, or the list it is directly in; holder: the place of the object with that field.
    scopes: the places of the objects around it, itself included, whose fields `scope` says yes to.
    inside: what stands for a container's members, by (members, kind).
    """
    none, at = F.lit(None), F.array().cast("array<int>")
    text = F.when(F.try_parse_json("payload").isNotNull(), F.trim("payload"))
    level = payloads.select(
        F.col(key).alias("key"), at.alias("at"), F.array().cast("array<string>").alias("path"), none.cast("string").alias("via"), none.cast("array<int>").alias("holder"),
        F.array().cast("array<array<int>>").alias("scopes"), F.left(text, F.lit(1)).alias("kind"), text.alias("text"),
    ).where(F.col("kind").isin("{", "["))
    levels = []
    while True:
        within = members(F.col("text"), F.col("kind"))
        level = level.withColumn("members", inside(within, F.col("kind")) if inside else within).drop("text")
        if scope:
            level = level.withColumn("scopes", F.when((F.col("kind") == "{") & F.coalesce(scope(F.col("members")), F.lit(False)), F.array_append("scopes", F.col("at"))).otherwise(F.col("scopes")))
        level = checkpointed(level)
        if level.isEmpty():
            break
        levels.append(level)
        inner = level.select("*", F.posexplode("members").alias("pos", "m")).where(F.col("m.kind").isin("{", "["))
        own = F.col("kind") == "{"
        level = inner.select(
            "key", F.array_append("at", F.col("pos")).alias("at"), F.array_append("path", F.coalesce("m.name", F.col("pos").cast("string"))).alias("path"),
            # a list passes on the field it is in, but a list in a list does not
            F.when(own, F.col("m.name")).when(F.col("m.kind") == "{", F.col("via")).alias("via"), F.when(own, F.col("at")).otherwise(F.col("holder")).alias("holder"),
            "scopes", F.col("m.kind").alias("kind"), F.col("m.text").alias("text"),
        )
    return reduce(DataFrame.unionByName, levels) if levels else level


def objects(payloads: DataFrame, key: str, scope=None) -> DataFrame:
    """Every object of each payload with its fields; see opened()."""
    return opened(payloads, key, scope=scope).where("kind = '{'").withColumnRenamed("members", "fields").drop("kind")


# Fields of one object


def field(fields: Column, name: str) -> Column:
    return F.get(F.filter(fields, lambda m: m["name"] == name), F.lit(0))


def scalar_text(m: Column) -> Column:
    """A member's text; of a container one with a space after its commas, as such texts are read by eye."""
    return F.when(m["kind"].isin("{", "["), F.regexp_replace(m["text"], ",", ", ")).otherwise(m["text"])


def float_of(m: Column) -> Column:
    number = F.when(m["kind"] == "0", m["text"].try_cast("double")).when(m["kind"] == "b", F.when(m["text"] == "true", 1.0).otherwise(0.0))
    return F.coalesce(F.when(F.abs(number) < float("inf"), number), F.when(~m["kind"].isin("0", "b"), P.as_float(scalar_text(m))))


def count_of(m: Column) -> Column:
    """A number of things (see parsing.as_count) of any member."""
    x = float_of(m)
    return F.when(m["kind"].isin("0", "b"), F.when(x >= 0, F.rint(x).cast("long"))).otherwise(P.as_count(scalar_text(m)))


def whole_of(m: Column) -> Column:
    """An integer as said; a number's whole part."""
    return F.when(m["kind"] == '"', F.when(F.trim(m["text"]).rlike(r"^[+-]?\d+$"), F.trim(m["text"]).try_cast("long"))).when(m["kind"].isin("0", "b"), float_of(m).cast("long"))


def said(m: Column) -> Column:
    """A member's text unless it is null or empty."""
    return F.when(m["text"] != "", m["text"])


def is_one_of(m: Column, wanted: tuple[str, ...]) -> Column:
    return P.normal_key(m["name"]).isin(*wanted)


def with_counts(rows: DataFrame) -> DataFrame:
    """rows of objects with `counted` (name, key and number of each field), and `beside`, the key that a naming field names and the number beside it."""
    rows = rows.withColumn("counted", F.transform("fields", lambda m: F.struct(m["name"].alias("name"), P.normal_key(m["name"]).alias("key"), count_of(m).alias("n"))))
    named = F.coalesce(*[field(F.col("fields"), n) for n in NAMES])
    return rows.withColumn("beside", F.struct(P.normal_key(named["text"]).alias("key"), F.coalesce(*[field(F.col("counted"), n)["n"] for n in VALUES]).alias("n")))


def named_count(wanted: tuple[str, ...]) -> Column:
    """The number under one of the wanted names, or else beside one of them that is the value of a naming field."""
    under = F.get(F.filter("counted", lambda m: m["key"].isin(*wanted) & m["n"].isNotNull()), F.lit(0))["n"]
    return F.coalesce(under, F.when(F.col("beside.key").isin(*wanted), F.col("beside.n")))


def has_any(fields: Column, names: tuple[str, ...]) -> Column:
    return F.exists(fields, lambda m: m["name"].isin(*names))


def first_episode(fields: Column) -> Column:
    """The episode that an object says it is of, by the first of EPISODES that it has."""
    return whole_of(F.coalesce(*[field(fields, n) for n in EPISODES]))


def earliest(value: Column, *by: str, where: Column | None = None) -> Column:
    """The value that is not null of the first row."""
    good = value.isNotNull() if where is None else value.isNotNull() & where
    return F.min_by(value, F.when(good, F.struct(*by)))


def day_of(text: Column) -> Column:
    """The date that a text starts with, or that it is in one of DAY_FORMS, as an ISO text."""
    t = F.trim(text)
    forms = [F.date_format(F.try_to_timestamp(t, F.lit(form)), "yyyy-MM-dd") for form in DAY_FORMS]
    return F.coalesce(F.nullif(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), *forms)


# Facts of documents


def payload_facts(payloads: DataFrame, key: str) -> DataFrame:
    """Of each row of payloads (key, payload): the latest episode, people by distance, the model and the best advisory; what is not told is null.

    People are looked for in the objects of the data source POP where a document has any. Of the timeline's steps the best
    is current and actual, then actual, then the latest advisory, then the first.
    """
    pop = lambda fields: P.normal_key(F.coalesce(said(field(fields, "datasource")), said(field(fields, "data_source")))) == "POP"
    rows, f = with_counts(objects(payloads, key, scope=pop)), F.col("fields")
    found = {n: named_count(wanted) for n, wanted in PEOPLE.items()}
    found |= {out: said(field(f, n)) for n, out in MODELS.items()}
    episode = F.array_max(F.array(*[whole_of(field(f, n)) for n in EPISODES]))
    yes = lambda n: P.truthy(field(f, n)["text"])
    at = F.coalesce(*[F.try_to_timestamp(F.trim(field(f, "advisory_datetime")["text"]), F.lit(form)) for form in ADVISORY_FORMS], F.lit(0).cast("timestamp"))
    rank = F.struct((~(yes("current") & yes("actual"))).alias("a"), (~yes("actual")).alias("b"), (-F.unix_micros(at)).alias("c"), "holder", "at")
    step = F.struct(
        *[field(F.col("counted"), n)["n"].alias(out) for n, out in WINDS.items()], said(field(f, "id")).alias("advisory"), said(field(f, "advisory_number")).alias("advisory_number"), said(field(f, "advisory_datetime")).alias("advisory_time"),
        said(field(f, "wind_speed")).alias("wind_speed"), said(field(f, "coordinates")).alias("coordinates"), said(field(f, "alertscore")).alias("alert_score"), yes("actual").alias("advisory_actual"), yes("current").alias("advisory_current"),
    )
    is_step = has_any(f, tuple(WINDS))
    rows = rows.select("key", "at", "scopes", "via", "holder", episode.alias("episode"), *[c.alias(n) for n, c in found.items()], step.alias("step"), rank.alias("rank"), is_step.alias("is_step"))
    scoped = F.size("scopes") > 0
    told = rows.groupBy("key").agg(
        F.max("episode").alias("latest_episode"), F.max(scoped).alias("has_pop"),
        *[earliest(F.col(n), "at", where=scoped).alias(f"in_{n}") for n in PEOPLE], *[earliest(F.col(n), "at").alias(n) for n in (*PEOPLE, *MODELS.values())],
        F.min_by("step", F.when(F.col("is_step") & (F.col("via") == "item"), F.col("rank"))).alias("listed"), F.min_by("step", F.when(F.col("is_step"), F.col("rank").withField("holder", F.array().cast("array<int>")))).alias("loose"),
    )
    told = told.withColumn("best", F.coalesce("listed", "loose"))
    people = [F.when(F.col("has_pop"), F.col(f"in_{n}")).otherwise(F.col(n)).alias(n) for n in PEOPLE]
    told = told.select(F.col("key").alias("__key"), "latest_episode", *people, *MODELS.values(), "best.*")
    return payloads.select(key).join(told, F.col(key) == F.col("__key"), "left").drop("__key")


def payload_episodes(payloads: DataFrame, key: str, episode: str) -> DataFrame:
    """Area, dates and duration of the episode that each row of payloads (key, payload, episode) asks for; null asks for the whole document.

    They are looked for in the objects that name the episode, one after the other, or in the whole document where none does;
    a duration that is not told comes from the dates.
    """
    asked = payloads.select(F.col(key).alias("key"), F.col(episode).cast("long").alias("asked"))
    rows = objects(payloads, key, scope=lambda fields: first_episode(fields).isNotNull())
    # the scopes of other episodes go: an object counts for those that name the one asked for
    f = F.col("fields")
    rows = rows.join(asked, "key").withColumn("own", F.when(first_episode(f) == F.col("asked"), F.col("at")))
    wanted = rows.where("own is not null").groupBy("key").agg(F.collect_set("own").alias("wanted"))  # at most one a object of the document
    rows = rows.join(wanted, "key", "left")
    scopes = F.coalesce(F.array_intersect("scopes", "wanted"), F.array(F.array().cast("array<int>")))
    rows = rows.withColumn("scope", F.explode(scopes))
    first_field = lambda names: F.get(F.filter(f, lambda m: is_one_of(m, names) & said(m).isNotNull()), F.lit(0))
    texts = F.coalesce(*[F.when(P.area_text(field(f, n)["text"]).isNotNull(), F.struct(P.area_text(field(f, n)["text"]).alias("ha"), F.lit(n).alias("name"))) for n in AREA_TEXTS])
    first = {"area": first_field(AREA), "start": first_field(FROM), "last": first_field(TO), "days": first_field(DURATION), "words": texts}
    by_scope = rows.select("key", "scope", "at", *[c.alias(n) for n, c in first.items()]).groupBy("key", "scope").agg(*[earliest(F.col(n), "at").alias(n) for n in first])
    ha = float_of(F.col("area"))
    area = F.when(ha >= 0, F.struct(ha.alias("ha"), F.col("area.name").alias("name")))
    days = F.when(count_of(F.col("days")).isNotNull(), F.struct(count_of(F.col("days")).alias("n"), F.col("days.name").alias("name")))
    by_scope = by_scope.select("key", "scope", F.coalesce(area, "words").alias("area"), day_of(F.col("start.text")).alias("start"), day_of(F.col("last.text")).alias("last"), days.alias("days"))
    told = by_scope.groupBy("key").agg(*[earliest(F.col(n), "scope").alias(n) for n in ("area", "start", "last", "days")])
    between = F.datediff(F.col("last").try_cast("date"), F.col("start").try_cast("date")).cast("long")
    told = told.select(
        F.col("key").alias("__key"), F.col("area.ha").alias("burned_area_ha"), F.col("area.name").alias("area_field"), F.col("start").alias("start_date"), F.col("last").alias("last_detection"),
        F.coalesce("days.n", between).alias("duration_days"), F.coalesce("days.name", F.when(between.isNotNull(), "derived")).alias("duration_field"),
    )
    return payloads.select(key).join(told, F.col(key) == F.col("__key"), "left").drop("__key")


#: Fields that say which element of a list of objects comes first (fixed values).
LIST_ORDER = ("id", "origin", "source_id", "type")


def content(payloads: DataFrame, key: str, volatile: tuple[str, ...]) -> DataFrame:
    """key and `row`, a digest of a payload's content without the volatile fields at any depth: (parts, sum and exclusive or of their hashes).

    A part is a value with the names and places on the way to it. The order of fields does not count, nor does that of the
    elements of a list of objects, which stand in order of LIST_ORDER; decimals count to ten digits. A payload that is no JSON has no parts.
    """

    def inside(within: Column, kind: Column) -> Column:
        kept = F.filter(within, lambda m: ~F.coalesce(m["name"], F.lit("")).isin(*volatile))
        listed = F.transform(within, lambda m, i: F.struct(*[F.coalesce(F.get_json_object(m["text"], f"$.{n}"), F.lit("")).alias(n) for n in LIST_ORDER], i.alias("i"), m.alias("m")))
        ordered = F.transform(F.array_sort(listed), lambda x: x["m"])
        return F.when(kind == "{", kept).when(F.forall(within, lambda m: m["kind"] == "{"), ordered).otherwise(within)

    every = opened(payloads, key, inside)
    parts = every.select("key", "path", "kind", F.size("members").alias("n"), F.posexplode_outer("members").alias("pos", "m")).where("m is null or m.kind not in ('{', '[')")
    number = F.when((F.col("m.kind") == "0") & F.col("m.text").rlike("[.eE]"), F.round(F.col("m.text").try_cast("double"), 10).cast("string"))
    name = F.coalesce("m.name", F.col("pos").cast("string"))
    part = (F.array_join("path", "\x1f"), F.coalesce(name, F.lit("")), F.coalesce("m.kind", "kind"), F.coalesce(number, F.col("m.text"), F.lit("")))
    told = parts.select("key", F.xxhash64(*part).alias("h"), F.xxhash64(F.lit("again"), *part).alias("g")).groupBy("key")
    told = told.agg(F.struct(F.count("*").alias("parts"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("g").alias("either")).alias("row"))
    return payloads.select(key).join(told.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left").drop("__key")
