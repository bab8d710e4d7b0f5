"""python -m loomwright run.json: a whole run from a file.

The file holds ``settings`` (fields of Settings), ``tables`` (name: path of a parquet, CSV,
JSON or ORC dataset, or a table of the session's catalog) or ``jdbc`` (``url``, perhaps
``schema`` and ``tables``: all tables, keys and primary keys of a database), ``keys`` (as JSON
keys) and ``ddl`` or ``xml``: paths to ALTER TABLE statements or to an XML list of keys,
``primary`` (table: its key column) and ``not_null`` (table.column names), perhaps
``patterns`` (declared ones) and ``explore`` (rows of each class for a first stage).

``output`` is a folder for the main samples and journals as parquet. ``sink`` may instead be
"table", for tables of the catalog's database named by ``output``, or "view", for temporary
views of the session; ``backup`` keeps what stood in a table before under its name and _bkp.
``clean`` true first drops what earlier runs wrote into that database (main samples, journals and
their backups), "all" everything in it; views go before the tables that they read. ``folder`` is a
shared folder where a run that ended early left its sets, and where it goes on.
"""

from __future__ import annotations

import json
import sys
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions import PATTERNS
from .functions.declared import pattern
from .plans import journal
from .plans.run import run, two_stages
from .settings import Settings
from .sources.database import Database
from .sources.keys import ForeignKey, from_ddl, from_xml


def load(spark: SparkSession, source: str) -> DataFrame:
    kind = source.rsplit(".", 1)[-1]
    if kind == "csv":
        return spark.read.csv(source, header=True, inferSchema=True)
    if kind in ("parquet", "json", "orc"):
        return spark.read.format(kind).load(source)
    return spark.table(source)


def save(df: DataFrame, name: str, output: str, sink: str = "parquet", backup: bool = False) -> None:
    """Writes a result: as parquet in a folder, as a table of the catalog, or as a temporary view."""
    spark = df.sparkSession
    if sink == "view":
        df.createOrReplaceTempView(name)
    elif sink == "table":
        table = f"{output}.{name}" if output else name
        if backup and spark.catalog.tableExists(table):
            spark.table(table).write.mode("overwrite").saveAsTable(f"{table}_bkp")
        df.write.mode("overwrite").saveAsTable(table)
    elif sink == "parquet":
        df.write.mode("overwrite").parquet(f"{output.rstrip('/')}/{name}")
    else:
        raise ValueError(f"sink {sink}: parquet, table or view")


#: Beginnings of the names that a run writes.
OWN = ("mainsample_", "journal_")


def clean(spark: SparkSession, database: str, everything: bool = False) -> list[str]:
    """Drops a run's tables and views from a database, or all of them, views first; the names dropped, in order."""
    found = [t for t in spark.catalog.listTables(database) if not t.isTemporary and (everything or t.name.startswith(OWN))]
    ordered = sorted(found, key=lambda t: (t.tableType != "VIEW", t.name))
    for t in ordered:
        name = f"`{database}`.`{t.name}`"
        spark.sql(f"DROP {'VIEW' if t.tableType == 'VIEW' else 'TABLE'} IF EXISTS {name}")
    return [t.name for t in ordered]


def main(path: str, spark: SparkSession | None = None) -> None:
    config = json.loads(Path(path).read_text())
    spark = spark or SparkSession.builder.appName("loomwright").getOrCreate()
    settings = Settings(**config["settings"])
    tables = {name: load(spark, source) for name, source in config.get("tables", {}).items()}
    keys = [ForeignKey(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}) for x in config.get("keys", [])]
    primary, not_null = dict(config.get("primary", {})), list(config.get("not_null", []))
    if "jdbc" in config:
        with Database(spark, **{k: v for k, v in config["jdbc"].items() if k != "tables"}) as database:
            names = config["jdbc"].get("tables") or database.tables()
            tables |= {n: database.table(n) for n in names}
            keys += database.foreign_keys(names)
            primary |= database.primary_keys(names)
            not_null += database.not_null(names)
    if "ddl" in config:
        keys += from_ddl(Path(config["ddl"]).read_text())
    if "xml" in config:
        keys += from_xml(Path(config["xml"]).read_text())
    if config.get("clean") and config.get("sink") == "table":
        clean(spark, config.get("output") or spark.catalog.currentDatabase(), config["clean"] == "all")
    declared = [pattern(x) for x in config.get("patterns", [])]
    PATTERNS.update({p.key: p for p in declared})
    more = {"primary": primary, "not_null": not_null, "folder": config.get("folder")}
    with warnings.catch_warnings(record=True) as warned:
        warnings.simplefilter("always")
        result = two_stages(tables, keys, settings, config["explore"], **more)[1] if "explore" in config else run(tables, keys, settings, **more)
        samples = result.main_samples()
    for w in warned:
        warnings.warn_explicit(w.message, w.category, w.filename, w.lineno)
    used = [PATTERNS[k] for k in sorted({x.spec.pattern for x in result.journal.all})]
    journals = {
        "journal_predictor": journal.predictor_table(spark, result.journal, result.tables),
        "journal_table": journal.table_table(spark, result.tables),
        "journal_pattern": journal.pattern_table(spark, used),
        "journal_run": journal.run_table(spark, settings, len(result.tables), result.journal, result.finish, result.run_time, len(warned)),
        "journal_temporal": journal.temporal_table(spark, [(t.table, c, t.rows if c == t.temporal else None, c == t.temporal) for t in result.tables for c in t.candidates]),
    }
    for name, df in (samples | journals).items():
        save(df, name, config.get("output", ""), config.get("sink", "parquet"), config.get("backup", False))


if __name__ == "__main__":
    main(sys.argv[1])
