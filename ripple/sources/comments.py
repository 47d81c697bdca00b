"""
Reports as comments of pull requests, as a sink: ``df.write.format("ripple_comments")`` with rows (repository, number, body).

Each task writes the comments of its rows. A comment is found by its marker and replaced, so a repeated or lost attempt, or a run
after a failed one, leaves one comment; of several that attempts made at the same time the oldest stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..shipping import ship

SCHEMA = "repository string, number int, body string"


@dataclass
class Written(WriterCommitMessage):
    """What a task did, by kind."""

    created: int
    updated: int


class _Writer(DataSourceWriter):
    def __init__(self, api: str, token: str):
        self.api, self.token = api, token

    def write(self, iterator) -> Written:
        from ..plans import clients, report

        done = {"created": 0, "updated": 0}
        for row in iterator:
            client = clients.PullRequestComments(self.api, self.token, row["repository"], row["number"])
            done[report.upsert_comment(client, row["body"])] += 1
            report.keep_oldest(client)
        return Written(**done)

    def commit(self, messages) -> None:
        """Nothing is left to do: every task's comments are in place."""

    def abort(self, messages) -> None:
        """Comments of the tasks that ended stay; the next attempt finds them by their marker and replaces them."""


class CommentSink(DataSource):
    """Options: api (address of the service) and token, which Spark leaves out of what it shows because of its name."""

    @classmethod
    def name(cls):
        return "ripple_comments"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return _Writer(self.options["api"], self.options["token"])


def write(reports: DataFrame, api: str, token: str) -> None:
    """One comment for each pull request of ``reports`` (repository, number, body): of several bodies the last in order. Rows with nulls are left out."""
    spark = ship(reports).sparkSession
    spark.dataSource.register(CommentSink)
    keys = ["repository", "number"]
    one = reports.select(F.col("repository").cast("string"), F.col("number").cast("int"), F.col("body").cast("string")).dropna().groupBy(*keys).agg(F.max("body").alias("body"))
    one.write.format("ripple_comments").mode("append").option("api", api).option("token", token).save()
