"""View semantics on a tiny warehouse: stale rows, broken links, ties; and the plans of the views."""

import pytest
from pyspark.sql import functions as F

from narrata.plans import ask
from narrata.plans.views import Views


@pytest.fixture
def views(spark, sf):
    v = Views(spark, sf)
    v.tables.planned.update({n: v.tables[n] for n in ("DimFranchise", "DimWork", "DimScene", "FactEvent", "DimLocation", "DimAppearanceLook")})
    return v


def test_stale_inner_dimension_drops_events(views):
    base = views.tables["FactEvent"].where("IsActive AND IsLatest")
    gone = views.tables["DimFranchise"].where("NOT IsActive").select("FranchiseKey")
    assert base.join(gone, "FranchiseKey").count() > 0
    assert views["sem_event"].join(gone, "FranchiseKey").count() == 0


def test_stale_outer_dimension_nulls_its_columns(views):
    looks, current = views["sem_appearance_look"], views.tables["DimAppearanceLook"].where("IsActive AND IsLatest")
    assert looks.count() == current.count()
    assert looks.where("FranchiseKey = 4 AND FranchiseName IS NOT NULL").count() == 0
    assert looks.where("FranchiseKey = 4").count() > 0


def test_broken_location_chain_keeps_the_event(spark):
    rows = Views(spark, "/root/testdata/sf0.01")["sem_event"].where("LocationKey IS NOT NULL AND LocationName IS NULL")
    assert rows.count() > 0


def test_scene_density_guards_division(views):
    rows = views["mart_scene_event_density"]
    assert rows.where("DurationSec IS NULL AND EventsPerMinute IS NOT NULL").count() == 0
    assert rows.where("DurationSec = 0 AND EventsPerMinute IS NOT NULL").count() == 0
    assert rows.where("EventCount = 0 AND MinEventOrdinal IS NOT NULL").count() == 0


def test_ties_of_the_longest_scene_stay(spark, views):
    scenes = spark.createDataFrame([("w", "a", 90), ("w", "b", 90), ("w", "c", 10)], "WorkTitle string, SceneName string, DurationSec int")
    views.planned["learn_scenes"] = scenes
    from narrata.plans.lessons import LESSONS

    assert sorted(r["SceneName"] for r in ask.plan(LESSONS["L07_3b"], views).collect()) == ["a", "b"]


def test_outer_join_condition_is_no_filter(views):
    from narrata.plans.lessons import LESSONS

    rows = ask.plan(LESSONS["L10_8"], views)
    assert rows.where("ParticipantName IS NULL").count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixed_dimensions_are_broadcast_and_scans_are_pruned(views):
    df = views["sem_scene"].where(F.col("WorkCode") == "W3").select("SceneName")
    text = plan_of(df)
    assert text.count("BroadcastHashJoin") >= 2
    assert "TerrainRef" not in text and "DurationSec" not in text


def test_filters_reach_the_scan(spark, sf):
    from narrata.operators.queue import known_resources

    df = known_resources(spark.read.parquet(f"{sf}/events.parquet"), event_type="click", user_id=None).select("event_id")
    text = plan_of(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in text
    assert "props" not in text.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["mart_scene_event_density", "mart_event_interactions", "mart_asset_lifecycle", "mart_character_profile", "mart_event_timeline"])
def test_marts_read_the_stored_facts(spark, sf, name):
    """No mart numbers events or reads order lines again, and none joins the events with themselves."""
    text = plan_of(Views(spark, sf)[name])
    assert "Window" not in text and "lineitem" not in text
    facts = text.count("factevent")
    assert facts <= 2 if name == "mart_scene_event_density" else facts <= 1


def test_stored_tables_follow_the_data(spark, sf, tmp_path):
    """A table is loaded once for the data as it is, and again when a file has changed."""
    import shutil

    for t in ("region", "nation", "customer", "orders", "lineitem"):
        shutil.copy(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    first = Views(spark, str(tmp_path)).tables
    n = first["DimScene"].count()
    assert first._stored("DimScene") == Views(spark, str(tmp_path)).tables._stored("DimScene")
    spark.read.parquet(f"{sf}/orders.parquet").limit(100).write.parquet(str(tmp_path / "fewer"))
    shutil.rmtree(tmp_path / "orders.parquet", ignore_errors=True) or (tmp_path / "orders.parquet").unlink(missing_ok=True)
    (tmp_path / "fewer").rename(tmp_path / "orders.parquet")
    assert Views(spark, str(tmp_path)).tables["DimScene"].count() < n


def test_joins_on_the_bucket_key_need_no_exchange(spark, sf):
    t = Views(spark, sf).tables
    joined = t["BridgeEventParticipant"].select("EventKey", "EntityKey").hint("merge").join(t["FactEvent"].select("EventKey", "SceneKey"), "EventKey")
    assert "Exchange" not in plan_of(joined)


def test_stored_tables_hold_no_columns_made_of_others(spark, sf):
    """Guids don't compress: they are made when read, and equal the projection's."""
    t = Views(spark, sf).tables
    assert "EntityGuid" not in spark.table(t._stored("DimEntity")).columns
    assert t["DimEntity"].columns == t.projected("DimEntity").columns
    assert t["DimEntity"].exceptAll(t.projected("DimEntity")).count() == 0


def test_event_views_shuffle_their_rows_once(spark, sf, monkeypatch):
    """With no side small enough to broadcast, but for the fixed ones, only the join with entities moves rows."""
    from narrata.operators import relational

    monkeypatch.setattr(relational, "few", lambda df, *bounds: df)
    for name in ("sem_event_participant", "learn_event_participants"):
        text = plan_of(Views(spark, sf)[name])
        assert text.count("Exchange hashpartitioning") == 1, name


def test_rows_without_a_location_stay_where_they_are(spark, sf):
    """No shuffle by location: an eighth of the events has none and would meet in one task."""
    assert "Exchange hashpartitioning" not in plan_of(Views(spark, sf)["sem_event"].hint("merge"))


@pytest.fixture
def as_if_large(spark, monkeypatch):
    """Joins as planned where no side is small enough to broadcast, but for the fixed ones."""
    from narrata.operators import relational

    monkeypatch.setattr(relational, "few", lambda df, *bounds: df)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    yield
    for k, x in before.items():
        spark.conf.set(k, x)


def rows_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("name", ["sem_event", "mart_event_timeline", "learn_events", "mart_event_interactions", "mart_asset_lifecycle"])
def test_rows_without_a_location_go_to_many_tasks(spark, as_if_large, name):
    """Where locations are too many to broadcast, rows without one don't meet in one task of the outer join."""
    v = Views(spark, "/root/testdata/sf0.01")
    column = "Location" if name == "learn_events" else "LocationName"
    found = v[name].where(F.col(column).isNull()).select(column)
    tasks = rows_by_task(found)
    assert len(tasks) > 4 and max(tasks) < sum(tasks) / 2


def test_characters_are_not_dealt_out_by_species(spark, as_if_large):
    """Five species and none: characters dealt out by them would meet in six tasks, however many there are."""
    tasks = rows_by_task(Views(spark, "/root/testdata/sf0.01")["sem_character"].select("CharacterKey", "SpeciesName"))
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(tasks) < sum(tasks) / 4


@pytest.mark.parametrize("name", ["sem_event", "sem_character", "sem_location", "mart_event_interactions", "mart_asset_lifecycle"])
def test_views_of_large_tables_equal_sql(spark, sf, as_if_large, name):
    from narrata.plans.views import view_sql, with_ctes
    from tests import oracle

    oracle.check(Views(spark, sf)[name], oracle.connect(sf), with_ctes(view_sql(name)))


@pytest.mark.parametrize("name", ["sem_event_participant", "sem_event_asset", "mart_event_interactions", "mart_asset_lifecycle"])
def test_shared_event_keys_are_joined(spark, sf, tmp_path, name):
    """An order that is there twice, and one of more than 99 lines: the views are what SQL makes of them."""
    import shutil

    from narrata.plans.views import view_sql, with_ctes
    from tests import oracle

    for t in oracle.TABLES:
        if t not in ("orders", "lineitem"):
            shutil.copy(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    orders, lines = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    orders.where("o_orderkey < 60").unionByName(orders.where("o_orderkey = 8")).write.parquet(str(tmp_path / "orders.parquet"))
    many = lines.where("l_orderkey = 10").limit(1).crossJoin(spark.range(105).select(F.col("id").cast("int").alias("n"))).withColumn("l_linenumber", F.col("n") + 10).drop("n")
    lines.where("l_orderkey < 60").unionByName(many).write.parquet(str(tmp_path / "lineitem.parquet"))
    v = Views(spark, str(tmp_path))
    assert v.tables.events() is None
    oracle.check(v[name], oracle.connect(str(tmp_path)), with_ctes(view_sql(name)))
