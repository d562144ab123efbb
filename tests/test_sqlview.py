from surgewatch.sources import sqlview, tables
from surgewatch.sources.fixtures import Tables, alerts
from tests.conftest import SF_SMALL


def test_sql_on_view_and_parameter(spark):
    a = alerts(Tables(spark, SF_SMALL))
    via_view = sqlview.sql_on(spark, a, "alerts_t", "select country_code, count(*) as count from alerts_t "
                                                    "group by country_code")
    via_param = sqlview.sql_with(spark, "select country_code, count(*) as count from {a} group by country_code", a=a)
    direct = a.groupBy("country_code").count()
    key = ["country_code", "count"]
    assert sorted(via_view.select(*key).collect()) == sorted(via_param.select(*key).collect()) \
        == sorted(direct.select(*key).collect())
    assert spark.catalog.tableExists("alerts_t")


def test_month_literal_groups_by_two_keys(spark):
    df = spark.createDataFrame([(1, "A", "2024-01"), (1, "A", "2024-02"), (1, "B", "2024-01"), (2, "A", "2024-01")],
                               "agent_code bigint, country_code string, month string")
    sql = 'select agent_code, count(*) as count from {h} group by agent_code, country_code, "month"'
    assert sqlview.sql_with(spark, sql, h=df).count() == 3          # the literal does not split groups
    assert df.groupBy("agent_code", "country_code", "month").count().count() == 4


def test_read_schemas(spark, tmp_dir):
    t = Tables(spark, SF_SMALL)
    tables.export_tables(spark, {"region": t["region"], "nation": t["nation"]}, tmp_dir)
    assert tables.read_schemas(spark, tmp_dir) == {"region": t["region"].schema, "nation": t["nation"].schema}
