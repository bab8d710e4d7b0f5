"""Declared patterns and runs from a file."""

import datetime as dt
import json

import pytest
from loomwright.__main__ import main
from loomwright.functions.declared import library, pattern
from loomwright.functions.registry import Binding
from loomwright.plans.fuse import fused
from loomwright.sources.keys import key, to_xml


def test_declared_patterns(spark):
    made = library(
        json.dumps(
            [
                {"name": "Spread", "slots": ["numerical"], "aggregate": "max({numerical}) - {k} * min({numerical})", "parameters": {"k": [1, 2]}},
                {"name": "Half", "slots": ["numerical"], "row": "{numerical} / 2", "where": "{numerical} > 0"},
                {"name": "Steps", "slots": ["numerical", "temporal"], "lag": "sum({numerical} - {prev_0})", "inputs": ["{numerical}"]},
                {"name": "Kinds", "slots": ["nominal"], "counts": "count(*)"},
            ]
        )
    )
    assert [p.cardinality for p in made] == ["n", "1", "n", "n"]
    rows = [(1, float(x), dt.datetime(2020, 1, 1 + x)) for x in (1, 4, 6)]
    df = spark.createDataFrame(rows, "id int, x double, t timestamp_ntz")
    b = Binding(("id",), {"numerical": "x", "temporal": "t", "nominal": "x"}, {"k": 2})
    got = fused(df, b, [(p.key, p.build(b)) for p in made if p.cardinality == "n"]).first()
    assert (got["spread"], got["steps"], got["kinds"]) == (4.0, 5.0, 3)


def test_entries_without_a_kind_are_refused():
    with pytest.raises(ValueError):
        pattern({"name": "x", "slots": []})
    assert pattern({"name": "x", "aggregate": "max({base_date})"}).needs_date


def test_run_from_a_file(spark, tmp_path):
    people = spark.createDataFrame([(i, "p" if i % 2 else "n") for i in range(12)], "id int, y string")
    buys = spark.createDataFrame([(i, i // 3, float(i // 3 % 2 + i % 3)) for i in range(36)], "buy int, id int, amount double")
    people.write.parquet(f"{tmp_path}/people.parquet")
    buys.write.parquet(f"{tmp_path}/buys.parquet")
    config = {
        "settings": {"target_table": "people", "target_ids": ["id"], "targets": ["y"], "pattern_white": ["mine", "count"]},
        "tables": {n: f"{tmp_path}/{n}.parquet" for n in ("people", "buys")},
        "keys": [{"table": "people", "columns": ["id"], "f_table": "buys", "f_columns": ["id"]}],
        "patterns": [{"name": "Mine", "slots": ["numerical"], "aggregate": "sum({numerical})"}],
        "output": f"{tmp_path}/out",
    }
    (tmp_path / "run.json").write_text(json.dumps(config))
    main(str(tmp_path / "run.json"), spark)
    sample = spark.read.parquet(f"{tmp_path}/out/mainsample_y")
    assert sample.count() == 12 and any("mine" in c for c in sample.columns)
    assert spark.read.parquet(f"{tmp_path}/out/journal_predictor").count() > 0
    config |= {"keys": [], "xml": str(tmp_path / "keys.xml"), "primary": {"buys": "buy"}, "not_null": ["buys.amount"], "sink": "view", "output": ""}
    (tmp_path / "keys.xml").write_text(to_xml([key("people", "id", "buys")]))
    (tmp_path / "run.json").write_text(json.dumps(config))
    main(str(tmp_path / "run.json"), spark)
    assert spark.table("mainsample_y").count() == 12 and spark.table("journal_table").count() == 2
    for name in ("mainsample_y", "journal_predictor", "journal_table", "journal_pattern", "journal_run", "journal_temporal"):
        spark.catalog.dropTempView(name)
    config |= {"sink": "table", "backup": True}
    (tmp_path / "run.json").write_text(json.dumps(config))
    try:
        for _ in range(2):
            main(str(tmp_path / "run.json"), spark)
        assert spark.read.table("mainsample_y_bkp").count() == 12 and spark.catalog.tableExists("journal_run_bkp")
    finally:
        for name in ("mainsample_y", "journal_predictor", "journal_table", "journal_pattern", "journal_run", "journal_temporal"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            spark.sql(f"DROP TABLE IF EXISTS {name}_bkp")


def test_an_output_database_is_cleaned_views_first(spark, tmp_path):
    """A run's own tables and views go, views before tables; others only where all are to go."""
    from loomwright.__main__ import clean

    spark.sql(f"CREATE DATABASE IF NOT EXISTS cleaned LOCATION '{tmp_path}/cleaned'")
    try:
        for name in ("mainsample_y", "journal_run", "journal_run_bkp", "kept"):
            spark.range(2).write.saveAsTable(f"cleaned.{name}")
        spark.sql("CREATE VIEW cleaned.mainsample_view AS SELECT * FROM cleaned.mainsample_y")
        assert clean(spark, "cleaned") == ["mainsample_view", "journal_run", "journal_run_bkp", "mainsample_y"]
        assert [t.name for t in spark.catalog.listTables("cleaned") if not t.isTemporary] == ["kept"]
        assert clean(spark, "cleaned", everything=True) == ["kept"] and clean(spark, "cleaned") == []
    finally:
        spark.sql("DROP DATABASE cleaned CASCADE")
