"""JDBC access to the record tables, and SQL over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("usuarios", "estudiante", "programa", "documento")
# Hosts of this machine, which need no encrypted connection.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")
_SHORT = "postgres://"


def database_url(raw: str | None) -> str:
    """The URL with the long scheme name and, for PostgreSQL, an sslmode: none for a local server, required elsewhere.

    The rest stays as it is written: an sslmode goes behind the options that are there.
    """
    if not raw:
        raise RuntimeError("no database URL is configured")
    before, short, after = raw.partition(_SHORT)
    url = f"{before}postgresql://{after}" if short else raw
    if not re.match("postgres(ql)?://", url, re.IGNORECASE) or re.search(r"[?&]sslmode(=|&|#|$)", url):
        return url
    mode = "disable" if urlsplit(url).hostname in LOCAL_HOSTS else "require"
    head, mark, fragment = url.partition("#")
    joint = "" if head.endswith(("?", "&")) else "&" if "?" in head else "?"
    return f"{head}{joint}sslmode={mode}{mark}{fragment}"


def jdbc_options(raw: str | None, table: str) -> dict[str, str]:
    """Options of Spark's JDBC source for a table; the driver's jar has to be on the class path."""
    url = urlsplit(database_url(raw))
    name = url.hostname or ""
    host = f"{f'[{name}]' if ':' in name else name}{f':{url.port}' if url.port else ''}"
    out = {"url": f"jdbc:{url.scheme}://{host}{url.path}{'?' + url.query if url.query else ''}", "dbtable": table}
    return out | ({"user": unquote(url.username)} if url.username else {}) | ({"password": unquote(url.password)} if url.password else {})


def read_table(spark: SparkSession, raw: str | None, table: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A table over JDBC, in parallel ranges of `key` if its bounds are given."""
    options = jdbc_options(raw, table)
    if key and bounds:
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()


def append_table(rows: DataFrame, raw: str | None, table: str) -> None:
    """Appends rows over JDBC; a task that is done again may append its rows twice (see `publish`). `missing` tells whether they are there afterwards."""
    rows.write.format("jdbc").options(**jdbc_options(raw, table)).mode("append").save()


@contextmanager
def _transaction(spark: SparkSession, options: dict[str, str]) -> Iterator:
    """A JDBC connection of the driver whose statements count together or not at all."""
    properties = spark._jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in options:
            properties.setProperty(name, options[name])
    connection = spark._jvm.java.sql.DriverManager.getConnection(options["url"], properties)
    try:
        connection.setAutoCommit(False)
        yield connection
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def _run(connection, statement: str) -> int:  # noqa: ANN001
    s = connection.createStatement()
    try:
        return s.executeUpdate(statement)
    finally:
        s.close()


def _any(connection, query: str) -> bool:  # noqa: ANN001
    s = connection.createStatement()
    try:
        return s.executeQuery(query).next()
    finally:
        s.close()


def _exists(connection, table: str) -> bool:  # noqa: ANN001
    found = connection.getMetaData().getTables(None, None, "%", None)
    while found.next():
        if found.getString("TABLE_NAME").lower() == table.lower():
            return True
    return False


def publish(rows: DataFrame, options: dict[str, str], table: str, key: str, batch: int) -> int:
    """Appends a batch to a table once and whole, and returns how many rows came to it; a batch that was published before adds none.

    The tasks write to a staging table of the batch. One transaction then takes from it each row whose key the table
    doesn't have, and notes the batch in the table's ledger; so rows of tasks done twice count once, and a job that
    breaks leaves the table as it was. `options` are those of the JDBC source (see `jdbc_options`), of which `dbtable`
    isn't used. The key is unique; repeated rows of it have to be equal.
    """
    spark, staging, ledger = rows.sparkSession, f"{table}_staging_{batch}", f"{table}_batches"
    with _transaction(spark, options) as connection:
        if not _exists(connection, ledger):
            _run(connection, f"CREATE TABLE {ledger} (batch_id BIGINT NOT NULL PRIMARY KEY)")
        if _any(connection, f"SELECT batch_id FROM {ledger} WHERE batch_id = {int(batch)}"):
            return 0
        if _exists(connection, staging):  # of a try that broke
            _run(connection, f"DROP TABLE {staging}")
        _run(connection, f"CREATE TABLE {staging} AS SELECT * FROM {table} WITH NO DATA")
    rows.write.format("jdbc").options(**{**options, "dbtable": staging}).mode("append").save()
    with _transaction(spark, options) as connection:
        names = ", ".join(f'"{c}"' for c in rows.columns)
        fresh = f'NOT EXISTS (SELECT 1 FROM {table} t WHERE t."{key}" = s."{key}")'
        added = _run(connection, f"INSERT INTO {table} ({names}) SELECT DISTINCT {names} FROM {staging} s WHERE {fresh}")
        _run(connection, f"INSERT INTO {ledger} VALUES ({int(batch)})")
    with _transaction(spark, options) as connection:
        _run(connection, f"DROP TABLE {staging}")
    return added


def missing(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The rows whose key the table, read again after a write, doesn't have."""
    return rows.join(stored.select(F.col(key)).distinct(), key, "left_anti")


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Literal SQL in which `{name}` stands for a table."""
    return spark.sql(sql, **tables)
