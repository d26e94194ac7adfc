"""The list of queries: what each runs, and the SQL that states what must come out."""

from collections.abc import Callable, Sequence
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from strongbox.queries.views import VIEWS

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = (), recursive: bool = False):
    """Registers a query. ``sql`` may use the named views."""

    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql, views, recursive)
        return run

    return register


def with_views(sql: str, views: Sequence[str], recursive: bool = False) -> str:
    """``sql``, which may start with its own ``with``, behind the definitions of the views."""
    defined = [f"{v} as ({_plain(VIEWS[v])})" for v in _needed(views)]
    body = sql.strip()
    if body[:5].lower() == "with ":
        body = ", " + body[5:]
    return ("with recursive " if recursive else "with ") + ",\n".join(defined) + body if defined else sql


def _needed(views: Sequence[str]) -> list[str]:
    """The views and those they read, in the order of their definition."""
    wanted = set(views)
    while more := {f for v in wanted for f in _fields(VIEWS[v]) if f in VIEWS} - wanted:
        wanted |= more
    return [v for v in VIEWS if v in wanted]


def _fields(sql: str) -> set[str]:
    return {f for _, f, _, _ in Formatter().parse(sql) if f}


def _plain(sql: str) -> str:
    return sql.format(**{f: f for f in _fields(sql)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Times are compared in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the given tables."""
    return _select(spark, VIEWS[name], lambda f: view(spark, sf_dir, f) if f in VIEWS else table(spark, sf_dir, f))


def stream_view(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A view over the events as a stream."""
    return _select(spark, VIEWS[name], lambda f: stream(spark, sf_dir, f, files_per_batch))


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Files of a given table as a stream; a stream wants a pattern, even for one file."""
    files = f"{sf_dir}/{name}*.parquet"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    reader = spark.readStream.schema(spark.read.parquet(files).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(files)


def _select(spark: SparkSession, sql: str, source: Callable[[str], DataFrame]) -> DataFrame:
    return spark.sql(sql, **{f: source(f) for f in sorted(_fields(sql))})
