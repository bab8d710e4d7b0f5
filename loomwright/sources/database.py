"""Tables of a database server, with the keys that it knows.

Names, keys and indexes come from the JDBC driver's metadata through the driver's JVM; rows
are read by Spark, which pushes filters and columns down to the server. A driver that isn't
on Spark's class path must be added to it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .keys import ForeignKey
from .lists import chosen


class Database:
    """A connection for metadata, to be closed or used in a ``with`` block. options: as Spark's JDBC source takes them."""

    def __init__(self, spark: SparkSession, url: str, schema: str | None = None, **options: str):
        self.spark, self.url, self.schema, self.options = spark, url, schema, options
        jvm = spark._jvm
        if "driver" in options:
            jvm.java.lang.Class.forName(options["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        properties = jvm.java.util.Properties()
        for k, v in options.items():
            properties.setProperty(k, str(v))
        self._connection = jvm.java.sql.DriverManager.getConnection(url, properties)
        self._facts = self._connection.getMetaData()

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._connection.close()

    def _rows(self, found, *columns: str) -> Iterator[tuple]:
        """The rows of a result set: its columns, integers where their names begin with #."""
        try:
            while found.next():
                yield tuple(found.getInt(c[1:]) if c.startswith("#") else found.getString(c) for c in columns)
        finally:
            found.close()

    def schemas(self) -> list[str]:
        return chosen(name for (name,) in self._rows(self._facts.getSchemas(), "TABLE_SCHEM"))

    def tables(self, white: Iterable[str] = (), black: Iterable[str] = ()) -> list[str]:
        """Names of tables and views, in natural order, under the lists."""
        kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 2)
        kinds[0], kinds[1] = "TABLE", "VIEW"
        return chosen((name for (name,) in self._rows(self._facts.getTables(None, self.schema, "%", kinds), "TABLE_NAME")), white, black)

    def table(self, name: str) -> DataFrame:
        full = f"{self.schema}.{name}" if self.schema else name
        return self.spark.read.format("jdbc").options(**self.options, url=self.url, dbtable=full).load()

    def foreign_keys(self, names: Iterable[str]) -> list[ForeignKey]:
        """Each key between these tables once, from the table referred to; composite ones with their columns in order."""
        names = set(names)
        parts: dict[tuple, list[tuple[int, str, str]]] = defaultdict(list)
        for name in sorted(names):
            for to, to_column, table, column, place, key in self._rows(self._facts.getImportedKeys(None, self.schema, name), "PKTABLE_NAME", "PKCOLUMN_NAME", "FKTABLE_NAME", "FKCOLUMN_NAME", "#KEY_SEQ", "FK_NAME"):
                if to in names:
                    parts[to, table, key or ""].append((place, to_column, column))
        out = []
        for (to, table, key), columns in sorted(parts.items()):
            _, own, theirs = zip(*sorted(columns), strict=True)
            out.append(ForeignKey(to, own, table, theirs, key))
        return out

    def primary_keys(self, names: Iterable[str]) -> dict[str, str]:
        """Tables with a primary key, or else a unique index, of one column: that column."""
        out = {}
        for name in names:
            columns = [c for (c,) in self._rows(self._facts.getPrimaryKeys(None, self.schema, name), "COLUMN_NAME")]
            if len(columns) != 1:
                by_index: dict[str, list[str]] = defaultdict(list)
                for index, column in self._rows(self._facts.getIndexInfo(None, self.schema, name, True, False), "INDEX_NAME", "COLUMN_NAME"):
                    if index and column:
                        by_index[index].append(column)
                columns = next((c for _, c in sorted(by_index.items()) if len(c) == 1), [])
            if len(columns) == 1:
                out[name] = columns[0]
        return out

    def not_null(self, names: Iterable[str]) -> list[str]:
        """table.column names of the columns that are declared to hold no null."""
        return [f"{name}.{c}" for name in names for c, null in self._rows(self._facts.getColumns(None, self.schema, name, "%"), "COLUMN_NAME", "#NULLABLE") if null == 0]
