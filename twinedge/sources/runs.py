"""Training runs: each in a folder of its own, committed round by round.

    <root>/<run_id>/states/<round>-<attempt>   weights, best round, all metrics so far
    <root>/<run_id>/commits/<round>            names the state that counts
    <root>/<run_id>/models/<class>-epoch<n>    the best model
    <root>/<run_id>/reducer                    what the model's inputs were reduced by

A state holds everything that a round adds, so weights and metrics are committed
together or not at all: a state without its commit file is never read. The
commit file is created without overwriting, so of two writers of one round one
fails. A run that was cut off goes on from its last committed round.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinedge.sources.store import METRIC_SCHEMA, _filesystem, stored_models

STATE_SCHEMA = (
    "round int, best_round int, weights array<double>, "
    "history array<struct<epoch:int,split:string,metric:string,value:double>>"
)
STATES_KEPT = 2
"""A reader that has just looked up the latest state still finds it."""


@dataclass
class RunState:
    round: int
    best_round: int
    weights: list[float]
    history: list[tuple[int, str, str, float]] = field(default_factory=list)

    def losses(self) -> dict[int, float]:
        """Validation loss by round."""
        return {epoch: value for epoch, split, metric, value in self.history if (split, metric) == ("valid", "loss")}


class RunStore:
    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark = spark
        self.run_id = run_id
        self.path = f"{root.rstrip('/')}/{run_id}"

    @property
    def models(self) -> str:
        return f"{self.path}/models"

    @property
    def reducer(self) -> str:
        return f"{self.path}/reducer"

    def _commits(self) -> dict[int, str]:
        """State folder by committed round, from one listing and small files."""
        fs, folder = _filesystem(self.spark, f"{self.path}/commits")
        if not fs.exists(folder):
            return {}
        # a file without content was cut off while it was written: no commit
        found = [s for s in fs.listStatus(folder) if s.getLen()]
        rounds = [int(s.getPath().getName()) for s in found if s.getPath().getName().isdigit()]
        return {n: self._read(n) for n in sorted(rounds)[-STATES_KEPT:]}

    def _read(self, round_no: int) -> str:
        fs, file = _filesystem(self.spark, f"{self.path}/commits/{round_no}")
        stream = fs.open(file)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def committed_round(self) -> int:
        return max(self._commits(), default=0)

    def latest(self) -> RunState | None:
        """The last committed state: one row, as large as the model."""
        commits = self._commits()
        if not commits:
            return None
        row = self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.path}/states/{commits[max(commits)]}").first()
        return RunState(row["round"], row["best_round"], list(row["weights"]), [tuple(h) for h in row["history"]])

    def commit(self, state: RunState) -> None:
        """Make ``state`` the run's latest; an error if its round is committed already."""
        name = f"{state.round}-{uuid.uuid4().hex}"
        row = (state.round, state.best_round, [float(w) for w in state.weights], state.history)
        self.spark.createDataFrame([row], STATE_SCHEMA).coalesce(1).write.parquet(f"{self.path}/states/{name}")
        fs, file = _filesystem(self.spark, f"{self.path}/commits/{state.round}")
        if fs.exists(file) and not fs.getFileStatus(file).getLen():
            fs.delete(file, False)
        stream = fs.create(file, False)
        try:
            stream.writeUTF(name)
        finally:
            stream.close()
        self._expire(state.round)

    def _expire(self, last: int) -> None:
        """Remove states that no reader looks up any more; their commits stay."""
        fs, folder = _filesystem(self.spark, f"{self.path}/states")
        for status in fs.listStatus(folder):
            round_no = status.getPath().getName().partition("-")[0]
            if round_no.isdigit() and int(round_no) <= last - STATES_KEPT:
                fs.delete(status.getPath(), True)

    def metrics(self) -> DataFrame:
        """``(run_id, epoch, split, metric, value)`` of all committed rounds."""
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], METRIC_SCHEMA)
        state = self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.path}/states/{commits[max(commits)]}")
        return state.select(F.lit(self.run_id).alias("run_id"), F.inline("history"))

    def best_model(self) -> str | None:
        """Path of the best model of the last committed round."""
        state = self.latest()
        if state is None:
            return None
        name = next((n for n in stored_models(self.spark, self.models) if n.endswith(f"-epoch{state.best_round}")), None)
        return name and f"{self.models}/{name}"


def stored_runs(spark: SparkSession, root: str) -> list[str]:
    """Runs with a committed round, in the order of their names."""
    fs, folder = _filesystem(spark, root)
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())
    return [n for n in names if RunStore(spark, root, n).committed_round()]
